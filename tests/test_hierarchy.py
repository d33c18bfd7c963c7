import random
import re

from lexmill.operators import chunking, hierarchy


def machine(lines, n):
    """The title's nodes by a state machine over (text or None, page): an oracle of its own."""
    found, open_ = {0: dict(kind="preface", number=None, title="", start=None, end=None, body=[], up=(None, None, None))}, dict(subtitle=None, division=None, chapter=None, section=None)
    levels = ["subtitle", "division", "chapter", "section"]
    for i, (raw, page) in enumerate(lines, 1):
        text = None if raw is None else raw.strip()
        kind = number = title = None
        if text is not None:
            c = " ".join(text.split())
            words = c.split(" ", 2)
            token = re.sub(r"[.\-]+$", "", words[1]) if len(words) > 1 else ""
            rest = words[2] if len(words) > 2 else ""
            if c.lower().startswith("subtitle") and re.fullmatch("(?i)[IVXLCDM]+[A-Z]?", token) and not rest[:1].islower():
                kind, number, title = "subtitle", f"Subtitle {token.upper()}", rest
            elif (m := re.match(r"(?i)division (\d+) (.*)$", c)) and open_["subtitle"]:
                kind, number, title = "division", m[1], m[2]
            elif (m := re.match(rf"(?i)chapter ({n}\.[0-9a-z]+) (.*)$", c)) or (m := re.match(rf"Chapter ({n}\.[0-9A-Za-z]+)()$", c)):
                kind, number, title = "chapter", m[1], m[2]
            elif (m := re.match(rf"({n}\.[0-9A-Za-z]+(?:\.[0-9A-Za-z]+)+) (.*)$", c)) and open_["chapter"]:
                kind, number, title = "section", m[1], m[2]
        if kind:
            for level in levels[levels.index(kind) :]:
                open_[level] = None
            found[i] = dict(kind=kind, number=number, title=title, start=page, end=page, body=[], up=(i if kind == "subtitle" else open_["subtitle"], open_["division"], open_["chapter"]))
            open_[kind] = i
            continue
        s, ch = open_["subtitle"], open_["chapter"]
        if text is not None and text.lower() != "sections:":
            if s and not found[s]["title"] and not ch and not re.match(r"(?i)subtitle\b", text) and not text.lower().startswith("chapter "):
                found[s]["title"], found[s]["end"] = text, page
                continue
            if ch and not found[ch]["title"] and not open_["section"]:
                found[ch]["title"], found[ch]["end"] = text, page
                continue
        owner = found[open_["section"] or ch or open_["division"] or s or 0]
        owner["body"].append(text or "")
        owner["end"] = page
    return sorted((i, v["kind"], v["number"], v["title"], v["start"], "\n".join(v["body"]).strip()) for i, v in found.items() if i or v["body"])


LINES = ["Subtitle I Codes", "SUBTITLE IV", "Subtitles V X", "subtitle II lower", "Subtitle IIIA.", "Division 2", "Division 2 Zones", "division 3 more", "Chapter 23.44 Homes", "chapter 23.44 applies here", "CHAPTER 23.5", "Chapter 23.7",
         "23.44.010 Purpose", "23.44.010", "23.44.014.b Yards", "24.1.2 elsewhere", "Sections:", "some text", "More  text here", "  indented ", None, None, "Chapter one", "subtitle"]


def test_windows_equal_the_machine(spark):
    rng, pages, lines = random.Random(4), [], {}
    for t in range(150):
        own = [(rng.choice(LINES), p) for p in range(1, 4) for _ in range(rng.randint(1, 14))]
        lines[t] = own
        for p in range(1, 4):
            pages.append((23, 1000 * t + p, "\n".join("" if x is None else x for x, q in own if q == p)))
    df = spark.createDataFrame([(k[1] // 1000, k[1] % 1000, k[2]) for k in pages], "doc int, page_number int, text string")
    exploded = hierarchy.explode_lines(df.selectExpr("doc AS title_number", "page_number", "text"))
    # Titles are told apart by their number, patterns by 23: one window per document.
    from pyspark.sql import functions as F

    marked = hierarchy.headings(exploded.withColumn("_doc", F.col("title_number")).withColumn("title_number", F.lit(23)).withColumn("page_number", F.col("_doc") * 1000 + F.col("page_number")))
    marked = marked.withColumn("ord", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("_doc").orderBy("page_number", "line_no"))).withColumn("title_number", F.col("_doc")).withColumn("page_number", F.col("page_number") % 1000)
    got = {}
    for r in hierarchy.nodes(hierarchy.carry_forward(marked)).collect():
        if r.node or r.kind == "preface":
            got.setdefault(r.title_number, []).append((r.node, r.kind, r.number, r.title, r.start_page, r.text))
    for t, own in lines.items():
        assert sorted(got[t]) == machine(own, 23), own


PAGES = [
    (1, "Front matter"),
    (2, "Title 23 LAND USE\nSubtitle III Land Use\nDivision 2 Zones\nChapter 23.44 RESIDENTIAL\nSections:\n23.44.010 Purpose\n23.44.014 Yards"),
    (3, "Subtitle III Land Use\nDivision 2 Zones\nChapter 23.44 RESIDENTIAL\nIntro of the chap-\nter.\n23.44.010 Purpose\nThe purpose.\n\nMore of it.\n23-4.5 (Seattle 12-3)\n23.44.014 Yards\nA rear yard of 25 feet."),
    (4, "Chapter 23.45 MULTI\n23.45.001 Scope\nScope text.\n23.45.001 Scope"),
    (5, "Title 24 OTHER\nChapter 24.1 X"),
]


def test_tree_and_chunks(spark):
    pages = spark.createDataFrame(PAGES, "page_number int, text string")
    tree = hierarchy.title_tree(hierarchy.title_range(pages, 23, 24))
    subs = tree.filter("kind = 'subtitle'").collect()
    assert [(r.number, r.title, r.start_page) for r in subs] == [("Subtitle III", "Land Use", 3)]
    titles = spark.createDataFrame([(23, "", "file")], "title_number int, title_label string, source_path string")
    rows = chunking.tree_chunks(tree, titles).orderBy("ord").collect()
    assert [(r.chunk_id, r.text) for r in rows] == [
        ("smc-23-23-44-chapter-intro-0", "Intro of the chapter."),
        ("smc-23-23-44-section-23-44-010-0", "The purpose.\n\nMore of it."),
        ("smc-23-23-44-section-23-44-014-0", "A rear yard of 25 feet."),
        ("smc-23-23-45-section-23-45-001-0", "Scope text."),
    ]
    assert rows[1].full_citation == "SMC 23.44.010" and rows[0].full_citation is None and rows[1].title_label == "Title 23" and rows[2].division_title == "Zones"


def test_packers(spark):
    cases = ["a" * 899 + " b", "a" * 899 + " bc", "x" * 1500 + " y", "  \n\n ", "p1\n\n" + "w " * 600 + "\n\np3", " wide space ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = df.select("i", chunking.word_pack(df.t).alias("u"), chunking.word_pack_sql(df.t).alias("s"), chunking.paragraph_pack(df.t).alias("p")).orderBy("i").collect()
    assert all(r.u == (r.s or []) for r in got)
    assert [len(x) for x in got[0].u] == [901] or [len(x) for x in got[0].u] == [899, 1]
    assert got[2].u == ["x" * 1500, "y"] and got[3].p == [] and got[4].p[0] == "p1" and got[4].p[-1] == "p3"
