"""Markdown: sections, chunks, tags, links, snippets and blocks as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_WORDS, OVERLAP = 500, 50
#: Suggested tags and the words that call for them, in order.
SUGGESTIONS = {
    "#school": ["essay", "thesis", "assignment", "homework", "math", "class", "course", "lecture", "study", "university", "college", "professor"],
    "#coding": ["react", "python", "javascript", "code", "git", "api", "database", "sql", "function", "development", "bug", "node", "npm", "script", "rust", "go"],
    "#personal": ["subscription", "charge", "bank", "purchase", "progressive", "weed", "tiktok", "personal", "finance", "bill", "receipt"],
    "#second-brain": ["obsidian", "second brain", "rag", "embedding", "vector", "retrieve", "prompt", "chat", "archive"],
}
SHORT_SUGGESTIONS = {
    "#school": ["essay", "thesis", "class", "course", "lecture", "university", "college"],
    "#coding": ["react", "python", "javascript", "code", "git", "api", "sql", "node"],
    "#personal": ["subscription", "finance", "bill", "personal", "bank"],
    "#second-brain": ["obsidian", "rag", "embedding", "vector", "prompt"],
}
#: Tags of a path and the parts of it that call for them.
PATH_TAGS = {"school": ["school", "cs"], "coding": ["coding", "project", "developer"], "personal": ["personal"], "career": ["career"], "memory": ["memory"], "second-brain": ["ai chats", "claude", "copilot"]}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it. The optimiser writes a column's expression
    out wherever a filter or a lambda names the column."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def lines(text: Column) -> Column:
    """Lines of a text without their ends; a last line end opens no line."""
    others = r"[\r\x0b\f\x1c-\x1e\x85  ]"
    ends = lambda t: F.when(t.rlike(others), F.regexp_replace(t, r"\r\n|" + others, "\n")).otherwise(t)
    t = F.regexp_replace(let(F.coalesce(text, F.lit("")), ends), r"\n\z", "")
    return F.split(t, "\n", -1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _fences(ls: Column) -> Column:
    """``from, to`` of the fenced line ranges: a fold over the fence lines alone, which are few."""
    fence = r"^ {0,3}(`{3,}|~{3,})\s*(.*)$"
    some = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: (F.contains(s["x"], F.lit("```")) | F.contains(s["x"], F.lit("~~~"))) & s["x"].rlike(fence))
    marks = F.transform(some, lambda s: F.struct(s["i"].alias("i"), F.regexp_extract(s["x"], fence, 1).alias("m"), strip(F.regexp_extract(s["x"], fence, 2)).alias("info")))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<from:int,to:int>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        closes = (F.substring(s["m"], 1, 1) == F.substring(a["open"], 1, 1)) & (F.length(s["m"]) >= F.length(a["open"])) & (s["info"] == "")
        opened = F.struct(s["m"].alias("open"), s["i"].alias("at"), a["out"].alias("out"))
        closed = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("from"), s["i"].alias("to")))).alias("out"))
        return F.when(a["open"] == "", opened).when(closes, closed).otherwise(a)

    end = lambda a: F.when(a["open"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["at"].alias("from"), F.lit(2147483647).alias("to")))))
    return F.aggregate(marks, start, step, end)


#: Fixed value: an ATX heading.
HEADING = r"^ {0,3}#{1,6}\s+(.*)$"


def with_sections(df: DataFrame, text: str, name: str = "sections") -> DataFrame:
    """Adds ``sections``: array of (heading, text) cut at headings outside code fences. What stands before the first
    heading has heading ''; blank sections go."""
    def cut(ls: Column, fences: Column) -> Column:
        marked = F.filter(F.transform(ls, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda s: F.contains(s["s"], F.lit("#")) & s["s"].rlike(HEADING))
        heads = F.transform(F.filter(marked, lambda s: ~F.exists(fences, lambda r: (s["i"] >= r["from"]) & (s["i"] <= r["to"]))), lambda s: s["i"])
        return let(heads, lambda hs: let(F.array_distinct(F.concat(F.array(F.lit(0)), hs)), lambda at: parts(ls, hs, at)))

    def parts(ls: Column, hs: Column, at: Column) -> Column:
        heading = lambda a, k: F.when((k > 0) | (F.get(hs, F.lit(0)) == 0), strip(F.regexp_extract(F.get(ls, a), HEADING, 1))).otherwise("")
        body = lambda a, k: F.array_join(F.slice(ls, a + 1, F.coalesce(F.get(at, k + 1), F.size(ls)) - a), "\n")
        return F.filter(F.transform(at, lambda a, k: F.struct(heading(a, k).alias("heading"), body(a, k).alias("text"))), lambda s: s["text"].rlike(r"\S"))

    return df.withColumn(name, let(lines(F.col(text)), lambda ls: let(_fences(ls), lambda f: cut(ls, f))))


def windows(ws: Column, size: int = CHUNK_WORDS, overlap: int = OVERLAP) -> Column:
    """Word windows of ``size``, each starting ``size - overlap`` after the one before, while words are left."""
    starts = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return let(ws, lambda w: F.transform(starts(F.size(w)), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))


def chunked(sections: Column, size: int = CHUNK_WORDS, overlap: int = OVERLAP) -> Column:
    """Chunks (text, heading): neighbouring sections merged up to ``size`` words, longer ones cut into word windows."""
    kind = "array<struct<text:string,heading:string>>"
    none = F.from_json(F.lit("[]"), kind)
    start = F.struct(none.alias("out"), F.array().cast("array<string>").alias("texts"), F.lit(0).alias("n"), F.lit("").alias("heading"))
    flush = lambda a: F.when(F.size(a["texts"]) == 0, a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(F.array_join(a["texts"], "\n").alias("text"), a["heading"].alias("heading")))))

    def step(a: Column, s: Column) -> Column:
        n = s["n"]
        pieces = F.transform(windows(words(s["text"]), size, overlap), lambda t: F.struct(t.alias("text"), s["heading"].alias("heading")))
        big = F.struct(F.concat(flush(a), pieces).alias("out"), F.array().cast("array<string>").alias("texts"), F.lit(0).alias("n"), F.lit("").alias("heading"))
        new = F.struct(flush(a).alias("out"), F.array(s["text"]).alias("texts"), n.alias("n"), s["heading"].alias("heading"))
        more = F.struct(a["out"].alias("out"), F.concat(a["texts"], F.array(s["text"])).alias("texts"), (a["n"] + n).alias("n"), F.when(F.size(a["texts"]) == 0, s["heading"]).otherwise(a["heading"]).alias("heading"))
        return F.when(n > size, big).when(a["n"] + n > size, new).otherwise(more)

    counted = F.transform(sections, lambda s: F.struct(s["text"].alias("text"), s["heading"].alias("heading"), F.size(words(s["text"])).alias("n")))
    return F.aggregate(counted, start, step, flush)


def chunk_notes(notes: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """The chunk table of ``notes`` (path, title, category, mtime, content)."""
    x = with_sections(notes, "content").withColumn("tags", indexer_tags(F.col("content")))
    # outer, as the optimiser asks an inner one's array for its size in a filter of its own, which makes all chunks once more
    x = x.select("path", "title", "category", "mtime", "tags", F.posexplode_outer(chunked(F.col("sections"), size, overlap)).alias("chunk_ix", "c")).filter("c is not null")
    return x.select(
        F.concat("path", F.lit("_chunk_"), F.col("chunk_ix").cast("string")).alias("chunk_id"), F.col("path").alias("source"), "chunk_ix",
        F.col("c.text").alias("chunk"), F.col("c.heading").alias("heading"), "title", "tags", "category", "mtime",
    )


def indexer_tags(content: Column) -> Column:
    """Tags of a note with front matter: its list in brackets, else its list of lines, else tags of the body; none
    without front matter."""
    fm = F.regexp_extract(content, r"(?s)\A---\s*\n(.*?)\n---", 1)
    has = content.rlike(r"(?s)\A---\s*\n(.*?)\n---")
    inline, block = F.regexp_extract(fm, r"(?m)^tags:\s*\[([^\]]+)\]", 1), F.regexp_extract(fm, r"(?m)^tags:\s*\n((?:\s+-[^\n]+\n?)+)", 1)
    of_inline = F.transform(F.split(inline, ","), lambda t: F.regexp_replace(strip(t), "^#+", ""))
    of_block = F.transform(F.filter(F.split(block, "\n"), lambda s: s.rlike(r"\S")), lambda s: strip(F.regexp_replace(s, r"^\s*-\s*#?", "")))
    body = F.array_distinct(find_all(content, r"(?<!\w)#([A-Za-z][A-Za-z0-9_/-]*)", 1))
    return F.when(~has, F.array().cast("array<string>")).when(inline != "", of_inline).when(block != "", of_block).otherwise(body)


def health_tags(content: Column, dotall: bool = True) -> Column:
    """Tags of the body and the front matter together, sorted. ``dotall``: front matter of several lines counts, and a
    body tag begins with a letter or ``_``; else front matter of one line only, and any letter or digit begins a tag."""
    flag, first = ("(?s)", "[a-zA-Z_][a-zA-Z0-9_\\-/]*") if dotall else ("", "[\\p{L}\\p{N}_\\-/]+")
    body = find_all(content, rf"(?:^|\s)#({first})", 1) if not dotall else find_all(content, rf"(?<!\S)#({first})", 1)
    fm = F.regexp_extract(content, rf"{flag}\A---\r?\n(.*?)\r?\n---", 1)
    inline = F.regexp_extract(fm, r"(?m)^tags:\s*\[(.*?)\]", 1)
    has = fm.rlike(r"(?m)^tags:\s*\[(.*?)\]")
    of = F.filter(F.transform(F.split(inline, ","), lambda t: F.regexp_replace(F.regexp_replace(strip(t), '^"+|"+$', ""), "^'+|'+$", "")), lambda t: t != "")
    return F.array_sort(F.array_union(body, F.when(has, of).otherwise(find_all(fm, r"(?m)^\s*-\s*([^\s#]+)", 1))))


def report_links(content: Column) -> Column:
    """Link targets without alias, with anchor; web and file links left out, repeats kept."""
    return F.filter(F.transform(find_all(content, r"\[\[([^\]\|]+)(?:\|[^\]]+)?\]\]", 1), strip), lambda t: ~t.startswith("http") & ~t.startswith("file:"))


def graph_links(content: Column) -> Column:
    """Link targets without alias and anchor."""
    return F.transform(find_all(content, r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]", 1), strip)


def suggest_tags(title: Column, content: Column, rules: dict[str, list[str]] = SUGGESTIONS) -> Column:
    text = F.lower(F.concat_ws(" ", title, content))
    return F.array_compact(F.array(*(F.when(text.rlike("|".join(ws)), F.lit(tag)) for tag, ws in rules.items())))


def path_tags(path: Column) -> Column:
    p = F.lower(path)
    tags = F.array_compact(F.array(*(F.when(p.rlike("|".join(ws)), F.lit(t)) for t, ws in PATH_TAGS.items())))
    return F.when(F.size(tags) == 0, F.array(F.lit("second-brain"))).otherwise(tags)


#: Fixed value: a heading mark in snippets and blocks.
MARK = r"^(#{1,6})\s+(.*)$"


def clean_snippet(text: Column, title: Column) -> Column:
    """One line of plain text: no heading that repeats the title, no heading marks."""
    of = lambda s: F.when(s.rlike(MARK), strip(F.regexp_extract(s, MARK, 2))).otherwise(s)
    ls = F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda s: (s != "") & ~(s.rlike(MARK) & (of(s) == strip(title))))
    return strip(F.regexp_replace(F.array_join(F.transform(ls, of), " "), r"\s+", " "))


def note_blocks(text: Column, title: Column) -> Column:
    """Blocks (kind, text): headings, paragraphs and fenced code; a first heading that repeats the title goes."""
    fence = r"^\s*(`{3,}|~{3,})"
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,text:string>>")
    empty = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), empty.alias("para"), empty.alias("code"))
    put = lambda out, kind, t: F.concat(out, F.array(F.struct(F.lit(kind).alias("kind"), t.alias("text"))))
    flush = lambda a: F.when(F.size(a["para"]) == 0, a["out"]).otherwise(put(a["out"], "paragraph", F.array_join(a["para"], "\n")))
    acc = lambda out, para, code: F.struct(out.alias("out"), para.alias("para"), code.alias("code"))

    def step(a: Column, s: Column) -> Column:
        code = F.concat(a["code"], F.array(s))
        inside = F.when(s.rlike(fence), acc(put(a["out"], "code", F.array_join(code, "\n")), a["para"], empty)).otherwise(acc(a["out"], a["para"], code))
        head = strip(F.regexp_extract(strip(s), MARK, 2))
        f = flush(a)
        headed = acc(F.when((F.size(f) == 0) & (head == strip(title)), f).otherwise(put(f, "heading", head)), empty, empty)
        return (
            F.when(F.size(a["code"]) > 0, inside).when(s.rlike(fence), acc(f, empty, F.array(s))).when(~s.rlike(r"\S"), acc(f, empty, empty))
            .when(strip(s).rlike(MARK), headed).otherwise(acc(a["out"], F.concat(a["para"], F.array(s)), empty))
        )

    done = lambda a: F.when(F.size(a["code"]) > 0, put(flush(a), "code", F.array_join(a["code"], "\n"))).otherwise(flush(a))
    return F.aggregate(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n"), start, step, done)


def transcript_excerpt(text: Column) -> Column:
    """Opening of a transcript: its first user section, else its leading prose, from the first 8000 characters, 500 at most."""
    t = F.left(text, F.lit(8000))
    user = r"(?ims)^##\s+[^\n]*User\s*\n+(.*?)(?=\n##\s|\z)"
    lead = F.split(F.regexp_extract(t, r"(?s)\A(.*?)(?=(?:\A|\n)##|\z)", 1), "\n")
    keep = F.filter(lead, lambda s: ~s.startswith("# Chat Transcript") & ~s.startswith("*Source Log File") & (strip(s) != "---") & s.rlike(r"\S"))
    return F.when(t.rlike(user), F.left(F.regexp_replace(strip(F.regexp_extract(t, user, 1)), r"\s+", " "), F.lit(500))).otherwise(F.left(F.array_join(F.transform(keep, strip), " "), F.lit(500)))


def indexed_text(chunks: DataFrame) -> DataFrame:
    """``source, text``: a note's chunks in order without exact repeats."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "chunk"))), lambda x: x["chunk"])
    return chunks.filter(F.length("chunk") > 0).groupBy("source").agg(F.array_join(F.array_distinct(ordered), "\n\n").alias("text"))
