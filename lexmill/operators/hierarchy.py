"""Title trees from page text by windows: each line's owner is carried forward, then lines are grouped by owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import condense, is_footer, mend_hyphens, rstrip, strip
from lexmill.sources.folders import scratch


def title_range(pages: DataFrame, number: int, following: int | None) -> DataFrame:
    """The pages from the first that opens with the title's heading up to the first later one that opens the next title."""
    def opens(n: int) -> Column:
        return strip(F.coalesce("text", F.lit(""))).rlike(rf"(?iU)^Title\s+{n}\b")

    first = pages.filter(opens(number)).agg(F.min("page_number").alias("_first"))
    if following is None:
        bounds = first.withColumn("_end", F.lit(None).cast("int"))
    else:
        later = pages.join(F.broadcast(first), F.col("page_number") > F.col("_first")).filter(opens(following))
        bounds = first.join(F.broadcast(later.agg(F.min("page_number").alias("_end"))))
    inside = (F.col("page_number") >= F.col("_first")) & (F.col("_end").isNull() | (F.col("page_number") < F.col("_end")))
    return pages.join(F.broadcast(bounds), inside).select(F.lit(number).alias("title_number"), "page_number", F.coalesce("text", F.lit("")).alias("text"))


def explode_lines(pages: DataFrame) -> DataFrame:
    """``title_number, page_number, line_no, raw``: blank lines are null rows, footers are gone, others lose white space at the end."""
    lines = pages.select("title_number", "page_number", F.posexplode(F.split(mend_hyphens(F.col("text")), "\n")).alias("line_no", "_raw"))
    lines = lines.withColumn("raw", F.when(strip(F.col("_raw")) == "", None).otherwise(rstrip(F.col("_raw"))))
    return lines.filter(F.col("raw").isNull() | ~is_footer(F.col("raw"))).drop("_raw")


def _before(pages: DataFrame, **values: Column) -> DataFrame:
    """Per page what the aggregates ``values`` say of all earlier pages of its title: one narrow row per page, however many lines it has."""
    w = Window.partitionBy("_page.title_number").orderBy("_page.page_number").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select("_page", *(v.over(w).alias(name) for name, v in values.items()))


def _paged(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_page", F.struct("title_number", "page_number"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``ord``, their place in the title from 1: those of earlier pages are counted by page, so no task sorts a title's lines.

    The lines are stored first, so that counting them does not split the pages again.
    """
    path = scratch(lines.sparkSession, "split")
    lines.write.parquet(path)
    x = _paged(lines.sparkSession.read.parquet(path))
    earlier = _before(x.groupBy("_page").agg(F.count(F.lit(1)).alias("_n")), _earlier=F.sum("_n"))
    own = F.row_number().over(Window.partitionBy("_page").orderBy("line_no"))
    x = x.withColumn("ord", own).join(earlier, "_page")
    return x.withColumn("ord", (F.col("ord") + F.coalesce("_earlier", F.lit(0))).cast("int")).drop("_page", "_earlier")


_SUBTITLE = r"(?i)^subtitle\S*\s([IVXLCDM]+[A-Z]?)[.\-]*(?:\s(.*))?$"


def headings(lines: DataFrame) -> DataFrame:
    """Lines with ``ord`` and what each would open: kind0, number, title. The order of tests is subtitle, division, chapter, section."""
    c, prefix = F.col("cond"), F.concat(F.col("title_number").cast("string"), F.lit(r"\."))
    out = numbered(lines).withColumn("cond", condense(F.col("raw"))).withColumn("line", strip(F.col("raw")))

    def groups(pattern: Column, n: int) -> Column:
        return F.call_function("regexp_extract", c, pattern, F.lit(n))

    sub_title = strip(F.regexp_extract(c, _SUBTITLE, 2))
    sub = c.rlike(_SUBTITLE) & ~sub_title.rlike(r"^\p{Ll}")
    div = c.rlike(r"(?iU)^Division\s+(\d+)\s+(.*)$")
    full = F.concat(F.lit(r"(?i)^Chapter\s+("), prefix, F.lit(r"[0-9A-Za-z]+)\s+(.*)$"))
    short = F.concat(F.lit(r"^Chapter\s+("), prefix, F.lit(r"[0-9A-Za-z]+)\s*$"))
    section = F.concat(F.lit("^("), prefix, F.lit(r"[0-9A-Za-z]+(?:\.[0-9A-Za-z]+)+)\s+(.*)$"))
    is_full, is_short, is_section = (F.call_function("rlike", c, p) for p in (full, short, section))
    out = out.withColumn("kind0", F.when(c.isNull(), "blank").when(sub, "subtitle").when(div, "division").when(is_full, "chapter").when(is_short, "chapter_short").when(is_section, "section").otherwise("text"))
    k = F.col("kind0")
    number = F.when(k == "subtitle", F.concat(F.lit("Subtitle "), F.upper(F.regexp_extract(c, _SUBTITLE, 1)))).when(k == "division", F.regexp_extract(c, r"(?iU)^Division\s+(\d+)\s+(.*)$", 1))
    number = number.when(k == "chapter", groups(full, 1)).when(k == "chapter_short", groups(short, 1)).when(k == "section", groups(section, 1))
    title = F.when(k == "subtitle", sub_title).when(k == "division", strip(F.regexp_extract(c, r"(?iU)^Division\s+(\d+)\s+(.*)$", 2)))
    title = title.when(k == "chapter", strip(groups(full, 2))).when(k == "chapter_short", F.lit("")).when(k == "section", strip(groups(section, 2)))
    # What fails as a division (none before a subtitle) or section may still be a later kind.
    later = F.when(is_full, "chapter").when(is_short, "chapter_short").when(is_section, "section").otherwise("text")
    return out.withColumn("number", number).withColumn("title", title).withColumn("_if_not_division", later)


def carry_forward(lines: DataFrame) -> DataFrame:
    """Every line with the ``ord`` of the subtitle, division, chapter and section that are open at it (null: none) and its owner's.

    Windows over a page's lines take the place of the state machine: running
    maxima give the last heading of each kind, and a heading of a higher kind
    closes those below it. What earlier pages leave open comes from one row per
    page, so a task holds pages and not titles. The lines are stored once.
    """
    low = F.lower(F.col("line"))
    x = _paged(lines).drop("cond", "raw").withColumn("_bare", F.col("title") == "").withColumn("_plain", low != "sections:").withColumn("_names", low.rlike(r"(?U)^subtitle\b") | low.startswith("chapter "))
    path = scratch(lines.sparkSession, "lines")
    x.write.parquet(path)
    x = _open(lines.sparkSession.read.parquet(path))
    return title_fills(x).drop("_page", "_bare", "_plain", "_names", "_s", "_c")


def _open(x: DataFrame) -> DataFrame:
    """``kind`` and the open headings; ``_s`` and ``_c`` also tell whether the last subtitle and chapter lack a title."""
    k = F.col("kind0")
    heads = {"_s": k == "subtitle", "_c": k.isin("chapter", "chapter_short")}
    heads = {name: F.when(is_, F.struct("ord", "_bare")) for name, is_ in heads.items()}
    ords = {"_d": F.when(k == "division", F.col("ord")), "_e": F.when(k == "section", F.col("ord"))}
    first = F.when(k == "subtitle", F.col("ord"))
    pages = x.groupBy("_page").agg(*(F.max(v).alias(name) for name, v in (heads | ords).items()), F.min(first).alias("_f"))
    earlier = _before(pages, **{f"{name}0": F.max(name) for name in (*heads, *ords)}, _f0=F.min("_f"))
    x = x.join(earlier, "_page")
    upto = Window.partitionBy("_page").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    for name, v in (heads | ords).items():
        x = x.withColumn(name, F.coalesce(F.max(v).over(upto), F.col(f"{name}0")))
    x = x.withColumn("_f", F.coalesce(F.col("_f0"), F.min(first).over(upto)))
    # A division before any subtitle is text; a line that reads as a division can't be a chapter or section as well.
    kind = F.when((k == "division") & (F.col("_f").isNull() | (F.col("_f") > F.col("ord"))), F.col("_if_not_division")).when(k == "chapter_short", "chapter").otherwise(k)
    zero = F.lit(0)
    x = x.withColumn("sub", F.col("_s.ord")).withColumn("_d", F.when(F.col("_d") > F.col("_f"), F.col("_d")))
    x = x.withColumn("div", F.when(F.col("_d") > F.coalesce("sub", zero), F.col("_d")))
    x = x.withColumn("chap", F.when(F.col("_c.ord") > F.greatest(F.coalesce("sub", zero), F.coalesce("_d", zero)), F.col("_c.ord")))
    # A section where no chapter is open is text, so all since the open chapter are sections.
    x = x.withColumn("kind", F.when((kind == "section") & F.col("chap").isNull(), "text").otherwise(kind))
    x = x.withColumn("sec", F.when(F.col("_e") > F.col("chap"), F.col("_e")))
    return x.drop("_d", "_e", "_f", *(f"{name}0" for name in (*heads, *ords)), "_f0")


def title_fills(x: DataFrame) -> DataFrame:
    """Headings without a title take the first fitting text line, which then is no body; owners follow."""
    text = (F.col("kind") == "text") & F.col("_plain")
    fit_s = text & F.col("sub").isNotNull() & F.col("_s._bare") & F.col("chap").isNull() & ~F.col("_names")
    fit_c = text & F.col("chap").isNotNull() & F.col("_c._bare") & F.col("sec").isNull()
    fits = {"_fs": F.when(fit_s, F.col("ord")), "_fc": F.when(fit_c, F.col("ord"))}
    pages = x.groupBy("_page").agg(*(F.max(v).alias(name) for name, v in fits.items()))
    x = x.join(_before(pages, _fs0=F.max("_fs"), _fc0=F.max("_fc")), "_page")
    before = Window.partitionBy("_page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    for name, v in fits.items():
        x = x.withColumn(name, F.coalesce(F.max(v).over(before), F.col(f"{name}0"), F.lit(0)))
    x = x.withColumn("fill", F.when(fit_s & (F.col("_fs") < F.col("sub")), "subtitle").when(fit_c & (F.col("_fc") < F.col("chap")), "chapter"))
    owner = F.when(F.col("kind").isin("subtitle", "division", "chapter", "section"), F.col("ord")).when(F.col("fill") == "subtitle", F.col("sub")).when(F.col("fill") == "chapter", F.col("chap"))
    return x.withColumn("owner", owner.otherwise(F.coalesce("sec", "chap", "div", "sub", F.lit(0)))).drop("_fs", "_fc", "_fs0", "_fc0")


def nodes(x: DataFrame) -> DataFrame:
    """One row per node: kind, number, title, pages, text and parents; owner 0 is the title's preface."""
    heading = F.col("kind").isin("subtitle", "division", "chapter", "section") & F.col("fill").isNull()
    body = F.when(~heading & F.col("fill").isNull(), F.struct("ord", F.when(F.col("kind") == "blank", "").otherwise(F.col("line")).alias("line")))
    only = F.when(heading, F.struct("kind", "number", "title", "page_number", "sub", "div", "chap"))
    out = x.groupBy("title_number", "owner").agg(
        F.max(only).alias("h"),
        F.max(F.when(F.col("fill").isNotNull(), F.col("line"))).alias("_fill"),
        F.max("page_number").alias("end_page"),
        F.sort_array(F.collect_list(body)).alias("_body"),
    )
    lines = F.transform("_body", lambda r: r["line"])
    title = F.when(F.coalesce(F.col("h.title"), F.lit("")) == "", F.col("_fill")).otherwise(F.col("h.title"))
    return out.select(
        "title_number",
        F.col("owner").alias("node"),
        F.coalesce("h.kind", F.lit("preface")).alias("kind"),
        F.col("h.number").alias("number"),
        F.coalesce(title, F.lit("")).alias("title"),
        F.col("h.page_number").alias("start_page"),
        "end_page",
        strip(F.array_join(lines, "\n")).alias("text"),
        F.exists(lines, lambda v: v != "").alias("has_body"),
        F.col("h.sub").alias("sub"),
        F.col("h.div").alias("div"),
        F.col("h.chap").alias("chap"),
    )


def dedup_sections(sections: DataFrame, keys: list[str], order: str = "node") -> DataFrame:
    """Of sections with one citation the last with a body stays, else the last, in the place of the first."""
    row = F.struct(*(F.col(c) for c in sections.columns))
    picked = sections.groupBy(*keys).agg(F.max_by(row, F.struct("has_body", order)).alias("_r"), F.min(order).alias("slot"))
    return picked.select("_r.*", "slot")


def dedup_subtitles(subtitles: DataFrame, keys: list[str], weight: str = "weight", order: str = "node") -> DataFrame:
    """Of subtitles with one number the one of most divisions and chapters stays, the later of equals; sorted by start page."""
    row = F.struct(*(F.col(c) for c in subtitles.columns))
    picked = subtitles.groupBy(*keys).agg(F.max_by(row, F.struct(weight, order)).alias("_r"), F.min(order).alias("slot"))
    return picked.select("_r.*", "slot")


def title_tree(pages: DataFrame) -> DataFrame:
    """All surviving nodes of all titles with ``place``, their order in the tree.

    Chapters without a subtitle lose their sections, and their text goes to the
    preface; repeated sections and subtitles are resolved.
    """
    found = nodes(carry_forward(headings(explode_lines(pages))))
    lost = (F.col("kind").isin("chapter", "section", "division")) & F.col("sub").isNull()
    kept = found.filter(~lost)
    orphan = found.filter((F.col("kind") == "chapter") & F.col("sub").isNull()).groupBy("title_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "text"))), lambda r: r["text"]), "\n").alias("_orphans"))
    weights = kept.filter(F.col("kind").isin("division", "chapter")).groupBy("title_number", F.col("sub").alias("_s")).agg(F.count(F.lit(1)).alias("weight"))
    subs = kept.filter(F.col("kind") == "subtitle").join(weights.withColumnRenamed("title_number", "_t"), (F.col("title_number") == F.col("_t")) & (F.col("node") == F.col("_s")), "left").drop("_t", "_s")
    subs = dedup_subtitles(subs.withColumn("weight", F.coalesce("weight", F.lit(0))).withColumn("_n", F.lower("number")), ["title_number", "_n"]).drop("_n", "weight")
    alive = subs.select(F.col("title_number").alias("_t"), F.col("node").alias("_s"))
    inner = kept.filter(F.col("kind").isin("division", "chapter", "section")).join(alive, (F.col("title_number") == F.col("_t")) & (F.col("sub") == F.col("_s")), "left_semi")
    sections = dedup_sections(inner.filter(F.col("kind") == "section"), ["title_number", "chap", "number"])
    rest = inner.filter(F.col("kind") != "section").withColumn("slot", F.col("node"))
    preface = kept.filter(F.col("kind") == "preface").join(orphan.withColumnRenamed("title_number", "_t"), F.col("title_number") == F.col("_t"), "left")
    preface = preface.withColumn("text", strip(F.concat_ws("\n", F.nullif("text", F.lit("")), "_orphans"))).drop("_t", "_orphans").withColumn("slot", F.lit(0))
    return preface.unionByName(subs).unionByName(rest).unionByName(sections)
