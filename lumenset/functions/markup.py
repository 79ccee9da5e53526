"""Checks and repairs of HTML text as Column expressions."""

from pyspark.sql import Column, functions as F

# The markup that repaired pages receive and that checks look for.
DOCTYPE = "<!DOCTYPE html>"
HTML_OPEN = "<html lang='en'>"
HEAD = '<head><meta charset="UTF-8"><title>Dashboard</title></head>'
CHARSET = '<meta charset="UTF-8">'
VIEWPORT = '<meta name="viewport" content="width=device-width, initial-scale=1.0">'
BODY = "<body>\n</body>"
EMPTY_PAGE = (
    "<!DOCTYPE html><html><head><meta charset='UTF-8'><title>Error</title></head>"
    "<body><h2>No dashboard content generated.</h2></body></html>"
)
# (name in the page, text that shows its script is loaded, address of the script)
CHART_LIBRARIES = [
    ("Chart", "chart.js", "https://cdn.jsdelivr.net/npm/chart.js"),
    ("d3", "d3.v7.min.js", "https://d3js.org/d3.v7.min.js"),
]

SPACE = r"(?U)^\s+|(?U)\s+$"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def has(text: Column, part: str) -> Column:
    """Part occurs in the text, upper and lower case alike; ``part`` is lower case."""
    return F.contains(F.lower(text), F.lit(part))


def position(text: Column, part: str) -> Column:
    """1-based position in any case, 0 if absent."""
    return F.instr(F.lower(text), part)


def insert_at(text: Column, before: Column, part: str) -> Column:
    """Text with ``part`` after its first ``before`` characters."""
    return F.concat(F.substring(text, F.lit(1), before), F.lit(part), F.substring(text, before + 1, F.length(text)))


def head_content(text: Column) -> Column:
    """From ``<head>`` up to ``</head>`` or the end; empty without a head."""
    start, end = position(text, "<head>"), position(text, "</head>")
    length = F.when(end > 0, F.greatest(end - start, F.lit(0))).otherwise(F.length(text))
    return F.when(start > 0, F.substring(text, start, length)).otherwise(F.lit(""))


def starts_with_doctype(text: Column) -> Column:
    return F.startswith(F.lower(strip_space(text)), F.lit("<!doctype html"))


def add_doctype(text: Column) -> Column:
    return F.when(starts_with_doctype(text), text).otherwise(F.concat(F.lit(DOCTYPE + "\n"), text))


def add_html(text: Column) -> Column:
    at = F.instr(text, DOCTYPE)
    opened = F.when(at > 0, insert_at(text, at - 1 + len(DOCTYPE), "\n" + HTML_OPEN)).otherwise(text)
    closed = F.when(has(text, "</html>"), opened).otherwise(F.concat(opened, F.lit("\n</html>")))
    return F.when(has(text, "<html"), text).otherwise(closed)


def doctype_end(text: Column) -> Column:
    """Characters up to and including the tag that the text starts with."""
    return F.instr(text, ">")


def add_head(text: Column) -> Column:
    at = position(text, "<html>")
    before = F.when(at > 0, at - 1 + len("<html>")).otherwise(doctype_end(text))
    return F.when(position(text, "<head>") > 0, text).otherwise(insert_at(text, before, "\n" + HEAD + "\n"))


def _into_head(text: Column, missing: Column, part: str) -> Column:
    start = position(text, "<head>")
    return F.when((start > 0) & missing, insert_at(text, start - 1 + len("<head>"), part + "\n")).otherwise(text)


def add_charset(text: Column) -> Column:
    return _into_head(text, ~has(head_content(text), "<meta charset"), CHARSET)


def add_body(text: Column) -> Column:
    head_end, html_end = position(text, "</head>"), position(text, "</html>")
    added = (
        F.when(head_end > 0, insert_at(text, head_end - 1 + len("</head>"), "\n" + BODY))
        .when(html_end > 0, insert_at(text, html_end - 1, "\n" + BODY + "\n"))
        .otherwise(F.concat(text, F.lit("\n" + BODY)))
    )
    return F.when(has(text, "<body"), text).otherwise(added)


def add_viewport(text: Column) -> Column:
    return _into_head(text, ~has(head_content(text), '<meta name="viewport"'), VIEWPORT)


def is_unloaded(text: Column, name: str, script: str) -> Column:
    """The page names a chart library but does not load it."""
    return F.contains(text, F.lit(name)) & ~F.contains(text, F.lit(script))


def add_library(name: str, script: str, address: str):
    """A repair that loads the library at the end of the head."""

    def add(text: Column) -> Column:
        head_end = position(text, "</head>")
        tag = f'<script src="{address}"></script>\n'
        return F.when((head_end > 0) & is_unloaded(text, name, script), insert_at(text, head_end - 1, tag)).otherwise(text)

    return add


REPAIRS = [add_doctype, add_html, add_head, add_charset, add_body, add_viewport, *[add_library(*library) for library in CHART_LIBRARIES]]


def without_fence(text: Column, language: str = "html") -> Column:
    """Text inside a markdown code fence, trimmed; text without a fence is only trimmed."""
    trimmed = strip_space(text)
    tagged = "```" + language
    inner = F.substring(trimmed, F.lit(len(tagged) + 1), F.length(trimmed))
    last = F.length(inner) - F.instr(F.reverse(inner), "```") - 2
    untagged = F.when(F.endswith(strip_space(inner), F.lit("```")), F.substring(inner, F.lit(1), last)).otherwise(inner)
    body_length = F.length(trimmed) - F.when(F.endswith(trimmed, F.lit("```")), 6).otherwise(3)
    bare = F.substring(trimmed, F.lit(4), F.greatest(body_length, F.lit(0)))
    return strip_space(
        F.when(F.startswith(trimmed, F.lit(tagged)), untagged).when(F.startswith(trimmed, F.lit("```")), bare).otherwise(trimmed)
    )
