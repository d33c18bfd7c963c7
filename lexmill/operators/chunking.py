"""Trees to flat chunk tables of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import chunk_id, full_citation

MAX_CHARS = 900
#: Bytes of texts that are Python objects at a time.
SLICE = 1_000_000


def _words(text: str, most: int) -> list[str]:
    """Words joined by single spaces, as many as fit; a longer word stands alone."""
    out, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > most:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    return [*out, line] if line else out


def _paragraphs(text: str, most: int) -> list[str]:
    """Paragraphs joined by blank lines, as many as fit; a longer one is split by words and joins nothing."""
    import re

    out, held = [], ""
    for p in (q for x in re.split(r"\n\s*\n", text) if (q := x.strip())):
        if len(p) > most:
            out += [held] * bool(held) + _words(p, most)
            held = ""
        elif held and len(held) + 2 + len(p) > most:
            out.append(held)
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return [*out, held] if held else out


def _pieces(texts: pa.Array, split: Callable[[str], list[str]]) -> pa.Array:
    """The pieces of each text. Python holds about SLICE bytes of texts at a time, and gives memory back after each batch."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(lengths.astype(np.int64) + 64) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    kind = pa.list_(pa.string())
    out = [pa.array([split(t or "") for t in texts.slice(x, y - x).to_pylist()], kind) for x, y in zip(cuts, cuts[1:], strict=False)]
    found = out[0] if len(out) == 1 else pa.concat_arrays(out)
    del out
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do it by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    return found


def word_pack(c: Column, most: int = MAX_CHARS) -> Column:
    """``array<string>``: the text's words packed into pieces of at most ``most`` characters; an Arrow batch at a time."""

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        return _pieces(texts, lambda t: _words(t, most))

    return pack(c)


def paragraph_pack(c: Column, most: int = MAX_CHARS) -> Column:
    """``array<string>``: the text's paragraphs packed likewise."""

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        return _pieces(texts, lambda t: _paragraphs(t, most))

    return pack(c)


def word_pack_sql(c: Column, most: int = MAX_CHARS) -> Column:
    """``word_pack`` as a fold in the plan itself: slower, but visible to SQL."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["line"] == "") | (F.length(acc["line"]) + 1 + F.length(w) <= most)
        joined = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), F.when(fits, joined).otherwise(w).alias("line"))

    return F.aggregate(words, start, step, lambda a: F.when(a["line"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["line"]))))


def tree_chunks(tree: DataFrame, titles: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """The chunk table of title trees: per subtitle its own chapters first, then those of its divisions; intro before sections.

    ``tree`` has the nodes of ``hierarchy.title_tree``, ``titles`` one row per title
    with ``title_number, title_label, source_path``. Prefaces and the intros of
    subtitles and divisions give no chunks.
    """
    subs = tree.filter("kind = 'subtitle'").select(F.col("title_number").alias("_t"), F.col("node").alias("_s"), F.col("number").alias("subtitle_number"), F.nullif("title", F.lit("")).alias("subtitle_title"), F.struct("start_page", "slot").alias("_o1"))
    divs = tree.filter("kind = 'division'").select(F.col("title_number").alias("_t"), F.col("node").alias("_d"), F.col("number").alias("division_number"), F.col("title").alias("division_title"))
    chapters = tree.filter("kind = 'chapter'").select("title_number", F.col("node").alias("_c"), F.col("sub").alias("_s"), F.col("div").alias("_d"), F.col("number").alias("chapter_citation"), F.col("title").alias("chapter_title"), F.col("text").alias("_intro"), F.col("start_page").alias("_cs"), F.col("end_page").alias("_ce"))
    chapters = chapters.join(subs.withColumnRenamed("_t", "title_number"), ["title_number", "_s"]).join(divs.withColumnRenamed("_t", "title_number"), ["title_number", "_d"], "left")
    chapters = chapters.withColumn("_o2", F.struct(F.col("_d").isNotNull().alias("direct"), F.coalesce("_d", F.lit(0)).alias("d"), F.col("_c").alias("c")))
    intro = chapters.select("*", F.lit("chapter_intro").alias("chunk_type"), F.lit(None).cast("string").alias("section_citation"), F.lit(None).cast("string").alias("section_heading"), F.col("_intro").alias("_text"), F.col("_cs").alias("start_page"), F.col("_ce").alias("end_page"), F.lit(0).alias("_o3"))
    sections = tree.filter("kind = 'section'").select(F.col("title_number").alias("_t"), F.col("chap").alias("_p"), F.col("number").alias("section_citation"), F.col("title").alias("section_heading"), F.col("text").alias("_text"), "start_page", "end_page", F.col("slot").cast("int").alias("_o3"))
    found = chapters.withColumn("chunk_type", F.lit("section")).join(sections, (F.col("title_number") == F.col("_t")) & (F.col("_c") == F.col("_p"))).drop("_t", "_p")
    both = intro.unionByName(found.select(*intro.columns)).join(titles, "title_number")
    packed = both.select("*", F.posexplode(paragraph_pack(F.col("_text"), most)).alias("_i", "text"))
    return packed.select(
        chunk_id(F.col("title_number"), F.col("chapter_citation"), F.col("section_citation"), F.col("_i")).alias("chunk_id"),
        "chunk_type", "text", "source_path", "title_number",
        F.coalesce(F.nullif(F.trim("title_label"), F.lit("")), F.concat(F.lit("Title "), F.col("title_number"))).alias("title_label"),
        "subtitle_number", "subtitle_title", "division_number", "division_title", "chapter_citation", "chapter_title", "section_citation", "section_heading",
        full_citation(F.col("section_citation")).alias("full_citation"), "start_page", "end_page", F.length("text").alias("char_count"),
        F.struct(F.col("title_number").alias("t"), F.col("_o1").alias("a"), F.col("_o2").alias("b"), F.col("_o3").alias("c"), F.col("_i").alias("d")).alias("ord"),
    )
