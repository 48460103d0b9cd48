"""Scripts for reading a Markdown report aloud: its lines as an introduction and its sections, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scripts: ordinals of sections and counts of them (digits beyond ten), the tag of a pause between sections, the
# sentences of the introduction and of a section, and characters that are only part of others' look.
ORDINALS = ("첫", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉", "열")
COUNTS = ("한", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉", "열")
PAUSE = "<long pause>"
INTRO, SECTION = "{month}월 {day}일 커뮤니티 데일리 리포트입니다. 모두 {count} 가지 이야기를 전해 드립니다.", "{ordinal} 번째 이야기. "
MARKS = "`+|\\*\\*|__|~~|\\*"
UNSAID = "[\\p{So}\\p{Cs}\\p{Co}\\x{FE0E}\\x{FE0F}\\x{200D}\\x{20E3}]"
DOTS = "[·ㆍ]"
HEADING, LIST, QUOTE = r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", r"^\s*(?:[-*+]|[0-9]+[.)])\s+", r"^\s*>\s?"
ENDS = r"[.?!…]$"
BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def plain(text: Column) -> Column:
    """A line without links' targets, marks of emphasis and symbols, squeezed; middle dots are commas."""
    out = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, MARKS, ""), UNSAID, ""), DOTS, ", ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def ended(text: Column) -> Column:
    """text with a full stop if it ends without a mark of an end; '' stays."""
    return F.when((text == "") | text.rlike(ENDS), text).otherwise(F.concat(text, F.lit(".")))


def _word(values: tuple[str, ...], number: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, values)), number - 1), number.cast("string"))


def _let(value: Column, body) -> Column:
    """body of a value that is made once, as a lambda's variable: an expression within a lambda is made wherever it's named."""
    return F.transform(F.array(value), body)[0]


def _lines(lines: Column) -> Column:
    """Structs <head, said> of lines: whether it's a heading of the second level, and its title or what is read of the line ('' if nothing is)."""
    level = lambda x: F.char_length(x["mark"])
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_extract(x, HEADING, 1).alias("mark")))
    told = lambda x: F.when(level(x) > 0, F.regexp_extract(x["line"], HEADING, 2)).otherwise(x["line"])
    bare = lambda x: F.when(level(x) == 2, told(x)).otherwise(F.regexp_replace(F.regexp_replace(told(x), QUOTE, ""), LIST, ""))
    made = F.transform(marked, lambda x: F.struct((level(x) == 2).alias("head"), plain(bare(x)).alias("said")))
    return F.transform(made, lambda x: F.struct(x["head"].alias("head"), F.when(x["head"], x["said"]).when(x["said"].rlike(r"[\p{L}\p{N}]"), ended(x["said"])).otherwise("").alias("said")))


def _blocks(lines: Column) -> Column:
    """Structs <title, body>: the lines before the first heading, then each heading with those up to the next, as stretches between headings' places."""
    heads = F.filter(F.transform(lines, lambda x, i: F.when(x["head"], i + 1)), lambda i: i.isNotNull())

    def block(start: Column, end: Column) -> Column:
        body = F.filter(F.slice(lines, start + 1, end - start - 1), lambda x: x["said"] != "")
        return F.struct(F.get(lines, start - 1)["said"].alias("title"), F.transform(body, lambda x: x["said"]).alias("body"))

    return _let(heads, lambda at: F.transform(F.concat(F.array(F.lit(0)), at), lambda start, k: block(start, F.coalesce(F.get(at, k), F.size(lines) + 1))))


def script(markdown: Column, date: Column) -> Column:
    """struct<text, blocks, titles> of a report: what is read, with pauses; the introduction and the sections as they're read, without
    pauses; the sections' titles, in the order of their headings.

    date is a date. Lines without a letter or digit aren't read; those before the first heading of the second level follow the introduction, and
    headings of other levels are lines. Null Markdown is empty, a null date has a null script.
    """
    lines = _lines(F.split(F.coalesce(markdown, F.lit("")), BREAKS))
    return _let(_let(lines, _blocks), lambda b: _script(b, date))


def _script(blocks: Column, date: Column) -> Column:
    sections = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    month, rest = INTRO.split("{month}")[1].split("{day}")[0], INTRO.split("{day}")[1]
    before, after = rest.split("{count}")
    intro = F.concat(F.month(date).cast("string"), F.lit(month), F.dayofmonth(date).cast("string"), F.lit(before), _word(COUNTS, F.size(sections)), F.lit(after))
    intro = F.concat_ws(" ", intro, F.array_join(F.element_at(blocks, 1)["body"], " "))
    read = F.transform(sections, lambda s, i: F.trim(F.concat(_word(ORDINALS, i + 1), F.lit(SECTION.removeprefix("{ordinal}")), ended(s["title"]), F.lit(" "), F.array_join(s["body"], " "))))
    made = _let(F.concat(F.array(F.trim(intro)), read), lambda x: F.struct(F.array_join(x, f"\n{PAUSE}\n").alias("text"), x.alias("blocks"), F.transform(sections, lambda s: s["title"]).alias("titles")))
    return F.when(date.isNotNull(), made)
