"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .. import constants as K


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` mentions it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind: from the first other character to the last,
    for which only the ends are looked at character by character."""
    return F.regexp_extract(c, r"(?Us)\A\s*+(.*\S)", 1)


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_bold(c: Column) -> Column:
    return F.translate(c, K.BOLD_START + K.BOLD_END, "")


def tokens(c: Column, stop: bool = True) -> Column:
    """Index tokens; queries keep stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(K.INDEX_TOKEN), F.lit(0))
    keep = lambda t: (F.length(t) > 1) & ~t.isin(K.INDEX_STOP) if stop else F.length(t) > 1
    return F.filter(found, keep)


def snippet(c: Column, limit: int = 160) -> Column:
    return F.substring(collapse(c), 1, limit)


def slug(c: Column, limit: int = 60) -> Column:
    """URL-safe form of ASCII text; ``slug_any`` decomposes other characters first."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, limit), "-+$", "")
    return F.when(cut == "", "section").otherwise(cut)


@F.pandas_udf(StringType())
def ascii_form(c: pd.Series) -> pd.Series:
    """Compatibility decomposition, what is left of it in ASCII."""
    plain = lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    return c.map(plain)


def slug_any(c: Column, limit: int = 60) -> Column:
    return slug(ascii_form(c), limit)


def lines(c: Column) -> Column:
    """Lines as Python's splitlines sees them."""
    def kept(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return F.when(c == "", F.array().cast("array<string>")).otherwise(bound(F.split(c, K.LINE_BREAK), kept))


def summary(c: Column, limit: int = 320) -> Column:
    """First sentences of the lines longer than 30 characters; the first is kept whatever its length."""
    body = F.array_join(F.filter(F.transform(lines(c), strip), lambda x: F.length(x) > 30), " ")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def add(state: Column, sentence: Column) -> Column:
        full = state["full"] | ((F.length(state["out"]) + F.length(sentence) > limit) & (state["out"] != ""))
        more = strip(F.concat(state["out"], F.lit(" "), sentence))
        return F.struct(F.when(full, state["out"]).otherwise(more).alias("out"), full.alias("full"))

    return F.aggregate(F.split(collapse(body), K.SENTENCE_END), start, add, lambda s: s["out"])


def reflow(parts: Column) -> Column:
    """Visual lines joined to one text; a word hyphenated at a line's end is mended."""

    def add(out: Column, raw: Column) -> Column:
        line = strip(raw)
        hyphen = out.endswith("-") & F.substring(out, -2, 1).rlike(r"^\p{L}$") & (F.length(out) > 1)
        return (
            F.when(line == "", out).when(out == "", line)
            .when(hyphen, F.concat(F.regexp_replace(out, r"-\z", ""), line))
            .otherwise(F.concat(out, F.lit(" "), line))
        )

    joined = F.aggregate(parts, F.lit(""), add)
    for between in (" ", ""):
        joined = F.replace(joined, F.lit(K.BOLD_END + between + K.BOLD_START), F.lit(between))
    return strip(joined)


def is_data_like(c: Column) -> Column:
    """A short fragment such as a table cell."""
    t = strip(strip_bold(c))
    n = F.length(t)
    return (n > 0) & (n <= 14) & ~t.rlike(r"[.:;!?]\z") & (~t.contains(" ") | (n <= 8))


def word_total(c: Column) -> Column:
    t = strip(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def is_table_block(raw_lines: Column) -> Column:
    cells = F.filter(F.transform(raw_lines, lambda x: strip(strip_bold(x))), lambda x: x != "")
    short = F.filter(cells, lambda x: (F.length(x) <= 8) & (word_total(x) <= 2))
    return (F.size(cells) >= 3) & (F.size(short) / F.greatest(F.size(cells), F.lit(1)) >= 0.6)


def list_items(c: Column) -> Column:
    parts = F.split(strip_bold(c), K.BULLET_SPLIT)
    return F.filter(F.transform(parts, lambda p: strip(F.regexp_replace(p, K.BULLET_START, ""))), lambda x: x != "")


def classify(text: Column, size: Column, body: Column, bold: Column) -> Column:
    """``kind, text, level, items`` of a block."""
    plain = strip(strip_bold(text))
    items = list_items(text)
    is_list = plain.rlike(K.BULLET_START) & (F.size(items) > 0)
    big = (body != 0) & (size >= body * 1.18)
    numbered = plain.rlike(r"(?U)^\d+(\.\d+)*\s+\S")
    heading = (F.length(plain) <= 90) & ~plain.rlike(r"[.;]\z") & (big | (bold > 0.6) | (numbered & (bold > 0.3)))
    level = F.when((body != 0) & (size >= body * 1.6), 2).when(big, 3).otherwise(4)
    kind = F.when(plain == "", "para").when(is_list, "list").when(heading, "heading").otherwise("para")
    return F.struct(
        kind.alias("kind"),
        F.when((plain == "") | (kind == "list"), "").otherwise(text).alias("text"),
        F.when(kind == "heading", level).otherwise(0).alias("level"),
        F.when(kind == "list", items).otherwise(F.array().cast("array<string>")).alias("items"),
    )


def looks_like_code(block: Column) -> Column:
    """'asm', 'c' or '': by how many different hints occur."""
    hints = lambda s, some: sum((s.contains(h).cast("int") for h in some), F.lit(0))
    asm = bound(F.concat(F.lit(" "), F.lower(block), F.lit(" ")), lambda padded: hints(padded, K.ASM_HINTS))
    kind = lambda n: F.when((n["asm"] >= 2) & (n["asm"] >= n["c"]), "asm").when(n["c"] >= 3, "c").otherwise("")
    return bound(F.struct(asm.alias("asm"), hints(block, K.C_HINTS).alias("c")), kind)


def code_examples(text: Column, limit: int = 6) -> Column:
    blocks = F.filter(F.split(text, K.BLANK_LINE), lambda b: (F.length(b) <= 1500) & (F.size(lines(b)) >= 2))
    made = F.transform(
        blocks,
        lambda b: F.struct(
            F.lit(K.CODE_TITLE).alias("title"),
            looks_like_code(b).alias("language"),
            strip(F.array_join(F.transform(lines(b), lambda x: F.regexp_replace(x, r"(?U)\s+\z", "")), "\n")).alias("code"),
        ),
    )
    return F.slice(F.filter(made, lambda e: e["language"] != ""), 1, limit)


def registers(text: Column, limit: int = 30) -> Column:
    """Registers announced by headings, with the bit rows of the 1500 characters after each.

    That window is not cut at the next heading, so later registers' rows count for earlier ones.  A text is
    searched for headings once, a window for bit rows once."""
    none = F.array().cast("array<string>")
    every = lambda c, pattern, group: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))

    def row(found: Column) -> Column:
        group = lambda k: F.regexp_extract(found, K.BIT_ROW, k)
        return F.struct(
            F.replace(group(1), F.lit(" "), F.lit("")).alias("bits"), group(2).alias("name"),
            F.lit("").alias("access"), collapse(group(3)).alias("description"),
        )

    def announced(t: Column, h: Column) -> Column:
        def register(name: Column) -> Column:
            def made(at: Column) -> Column:
                end = F.aggregate(F.slice(h["steps"], F.lit(1), at), F.lit(0), lambda a, n: a + n)
                rows = bound(F.substring(t, end + 1, F.lit(1500)), lambda w: F.when(w.contains("Bit"), every(w, K.BIT_ROW, 0)).otherwise(none))
                return F.struct(
                    name.alias("name"), collapse(F.get(h["descriptions"], at - 1)).alias("description"), F.lit("").alias("address"),
                    F.transform(F.slice(rows, 1, 16), row).alias("fields"),
                )

            return bound(F.array_position(h["names"], name).cast("int"), made)

        return F.transform(F.slice(F.array_distinct(h["names"]), 1, limit), register)

    def scan(t: Column) -> Column:
        found = lambda group: F.when(~t.contains("Register"), none).otherwise(every(t, K.REGISTER_HEADING, group))
        steps = F.zip_with(found(0), F.split(t, K.REGISTER_HEADING, -1), lambda m, gap: F.length(m) + F.length(gap))
        heads = F.struct(found(1).alias("names"), found(2).alias("descriptions"), F.when(t.contains("Register"), steps).alias("steps"))
        return bound(heads, lambda h: announced(t, h))

    return bound(text, scan)


def escape(c: Column, quote: bool = True) -> Column:
    """HTML escapes; ``quote`` also escapes the apostrophe."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *([("'", "&#x27;")] if quote else [])]
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def human_size(n: Column) -> Column:
    f = n.cast("double")
    out = F.when(f < 1024, F.concat(f.cast("long").cast("string"), F.lit("B")))
    for unit, power in (("KB", 1), ("MB", 2)):
        out = out.when(f < 1024 ** (power + 1), F.format_string(f"%.1f{unit}", F.bround(f / 1024**power, 1)))
    return out.otherwise(F.format_string("%.1fGB", F.bround(f / 1024**3, 1)))


def glossary_keys(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(K.GLOSSARY_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.replace(F.upper(t), F.lit("²"), F.lit("2")))


def glossary_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in K.GLOSSARY.items() for x in pair])


def annotate(c: Column) -> Column:
    """Escaped text with the first occurrence of each glossary term explained."""
    gaps = F.split(c, K.GLOSSARY_TOKEN, -1)
    found = F.regexp_extract_all(c, F.lit(K.GLOSSARY_TOKEN), F.lit(0))
    keys, known = glossary_keys(c), glossary_map()

    def piece(t: Column, i: Column) -> Column:
        key = F.get(keys, i)
        meaning = F.try_element_at(known, key)
        plain = escape(t)
        marked = F.concat(F.lit('<abbr class="gloss" title="'), escape(meaning), F.lit('">'), plain, F.lit("</abbr>"))
        first = meaning.isNotNull() & (F.array_position(keys, key) == i + 1)
        return F.concat(F.when(first, marked).otherwise(plain), escape(F.get(gaps, i + 1)))

    return F.concat(escape(F.get(gaps, F.lit(0))), F.array_join(F.transform(found, piece), ""))


def highlight(text: Column, terms: list[str]) -> Column:
    """Each term marked in turn, whatever its case; later terms also meet earlier marks."""
    import re

    for t in terms:
        text = F.regexp_replace(text, "(?i)(" + re.escape(t) + ")", "<mark>$1</mark>")
    return text


def paragraphs(text: Column) -> Column:
    """Parts of a text between blank lines, those that aren't blank."""
    return F.filter(F.transform(F.split(text, K.BLANK_LINE), strip), lambda x: x != "")


INSTRUCTIONS = K.INSTRUCTIONS


def prompt(title: Column, text: Column, limit: int = K.PROMPT_CHARS) -> Column:
    """What a language model is asked about a section."""
    body = strip(text)
    body = F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit(K.PROMPT_CUT))).otherwise(body)
    before, between, after = K.PROMPT
    return F.concat(F.lit(before), title, F.lit(between), body, F.lit(after + K.INSTRUCTIONS))


def chunks(c: Column, limit: int = 1200) -> Column:
    """Lines packed greedily into chunks of about ``limit`` characters."""
    text = strip(c)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def add(s: Column, line: Column) -> Column:
        flush = (F.length(s["cur"]) + F.length(line) > limit) & (s["cur"] != "")
        out = F.when(flush, F.concat(s["out"], F.array(strip(s["cur"])))).otherwise(s["out"])
        cur = F.concat(F.when(flush, F.lit("")).otherwise(s["cur"]), line, F.lit("\n"))
        return F.struct(out.alias("out"), cur.alias("cur"))

    def finish(s: Column) -> Column:
        last = strip(s["cur"])
        return F.when(last != "", F.concat(s["out"], F.array(last))).otherwise(s["out"])

    packed = F.aggregate(F.split(text, "\n"), start, add, finish)
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(packed) == 0, F.array(F.substring(text, 1, limit))).otherwise(packed)
