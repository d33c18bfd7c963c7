"""Explicit schemas of the engine's tables; nothing is inferred."""

PAGES = "title_number int, page_number int, text string"
SECTION = "struct<citation:string,heading:string,start_page:int,end_page:int,text:string>"
CHAPTER = f"struct<citation:string,title:string,start_page:int,end_page:int,intro:string,sections:array<{SECTION}>>"
DIVISION = f"struct<number:string,title:string,start_page:int,end_page:int,intro:string,chapters:array<{CHAPTER}>>"
SUBTITLE = f"struct<number:string,title:string,start_page:int,end_page:int,intro:string,divisions:array<{DIVISION}>,chapters:array<{CHAPTER}>>"
TITLE = f"label string, number int, start_page int, end_page int, preface string, subtitles array<{SUBTITLE}>"
CHUNK = (
    "chunk_id string, chunk_type string, text string, source_path string, title_number int, title_label string, "
    "subtitle_number string, subtitle_title string, division_number string, division_title string, chapter_citation string, "
    "chapter_title string, section_citation string, section_heading string, full_citation string, start_page int, end_page int, char_count int"
)
EMBEDDINGS = "chunk_id string, embedding array<float>"
REQUESTS = "label string, query string, title_number int, section_prefix string, chunk_types array<string>, fts_query string, top_k int"
