"""Definition and reference tags from source text.

A tag is what a capture rule matches in the code of a file, which is its text without comments and literals (``lexing``).
A rule sees the whole code at once: each of its matches is put back with its name between two marks, and the line a name is on
is the line its marks are on. Everything about one file is computed from its own row, so tagging is a map: no shuffle,
whatever the corpus.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..sources.lexing import LANGUAGES, scanned
from ..sources.rules import EXTENSION_LANGUAGES, IDENTIFIER, KEYWORDS, RULES, Rule, guarded

# Line number of a reference that was filled in from identifier tokens.
BACKFILLED_LINE = -1

# Longest piece of a source line that is shown.
LINE_TEXT_LIMIT = 100

_MARK, _END = "\u0001", "\u0002"
# What is left of a match: the same text, with the name set off.
_SET_OFF = f"${{skip}}${{before}}{_MARK}${{name}}{_END}${{after}}${{pass}}"


def _lookup(table: dict, value_type: str, key: Column) -> Column:
    """Value of ``key`` in a constant table; null when it is not there.

    The table is given as JSON, which Spark folds into a single literal.
    """
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), f"map<string,{value_type}>"), key)


def language_of(path: Column, extensions: dict[str, str] | None = None) -> Column:
    """Language of a file by its extension; null when unknown."""
    return _lookup(EXTENSION_LANGUAGES if extensions is None else extensions, "string", extension(path))


def blank_skipped_text(content: Column, pattern: Column) -> Column:
    """Replace each comment and string (one match of ``pattern``) by a space plus the line breaks it held.

    Line numbers stay valid. Matches are set off by a control character, which splits the text into pieces of
    code (even places) and skipped text (odd places).
    """
    marked = F.regexp_replace(content, pattern, F.lit(f"{_MARK}$0{_MARK}"))
    pieces = F.transform(
        F.split(marked, _MARK),
        lambda piece, i: F.when(i % 2 == 0, piece).otherwise(
            F.concat(F.lit(" "), F.regexp_replace(piece, r"[^\n]+", ""))
        ),
    )
    return F.array_join(pieces, "")


def _hit(line: Column, kind: Column, extra: dict[str, Column], names: Column) -> Column:
    """Tags of one kind on one line."""
    return F.struct(line.alias("line"), kind.alias("kind"), *(v.alias(k) for k, v in extra.items()), names.alias("names"))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, though it is used inside inner loops."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _names_set_off(rules: list[Rule]) -> Column:
    """For each rule its kind and the code with the names it matches set off; matches without a name are not.

    Patterns are literals, so each is compiled once in a task.
    """

    def names(rule: Rule) -> Column:
        marked = F.regexp_replace("_code", F.lit(guarded(rule.pattern)), F.lit(_SET_OFF))
        return F.struct(F.lit(rule.kind).alias("kind"), F.replace(marked, F.lit(_MARK + _END), F.lit("")).alias("marked"))

    return F.array(*map(names, rules))


def _captured(found: Column, file: Column, extra: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """All hits of one rule in a file; a text without marks is not split into lines."""
    lines = F.transform(F.split(found["marked"], "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))

    def of_line(at: Column) -> Column:
        after_marks = F.slice(F.split(at["line"], _MARK), 2, F.length(at["line"]))
        names = F.transform(after_marks, lambda piece: F.substring_index(piece, _END, 1))
        number = F.coalesce(F.get(file["numbers"], at["i"]), at["i"])
        return _hit(number, found["kind"], extra(found["kind"], at["i"]), names)

    hits = F.transform(F.filter(lines, lambda at: F.contains(at["line"], F.lit(_MARK))), of_line)
    return F.when(F.contains(found["marked"], F.lit(_MARK)), hits).otherwise(F.slice(hits, 1, 0))


def tag_files(
    files: DataFrame,
    rules: list[Rule] | None = None,
    extensions: dict[str, str] | None = None,
    skipped: dict[str, str] | None = None,
    keywords: dict[str, list[str]] | None = None,
    backfill: bool = True,
    with_text: bool = False,
    with_scopes: bool = False,
) -> DataFrame:
    """Tags of all files in a language that has rules: ``repo_id, path, line, name, kind[, text][, scopes]``.

    Lines count from 0. A file with definitions and no references gets one reference per identifier token of
    its code, on line -1, duplicates kept, when ``backfill`` is set. ``with_text`` adds the start of the line
    a definition is on, so that source text need not be joined back later. ``with_scopes`` adds the heads that enclose
    a definition, outermost first: line and text.

    ``skipped`` gives, instead of the language's own way, a regular expression of what is not code; a language that has
    neither is code as a whole, with no scopes.
    """
    return tags_of_hits(file_hits(files, rules, extensions, skipped, keywords, backfill, with_text, with_scopes))


def file_hits(
    files: DataFrame,
    rules: list[Rule] | None = None,
    extensions: dict[str, str] | None = None,
    skipped: dict[str, str] | None = None,
    keywords: dict[str, list[str]] | None = None,
    backfill: bool = True,
    with_text: bool = False,
    with_scopes: bool = False,
) -> DataFrame:
    """``repo_id, path, hits``: the tags of ``tag_files``, a row for each file. Those of a line and rule are one hit."""
    rules = RULES if rules is None else rules
    keywords = KEYWORDS if keywords is None else keywords
    langs = sorted({rule.lang for rule in rules})
    lang = F.col("_lang")

    words = {name: list(keywords[name]) for name in langs if keywords.get(name)}
    found = F.lit(None)
    for name in langs:
        found = F.when(lang == name, _names_set_off([r for r in rules if r.lang == name])).otherwise(found)
    content = F.translate(F.regexp_replace("content", r"\r\n?", "\n"), _MARK + _END, "  ")
    files = (
        files.select("repo_id", "path", language_of(F.col("path"), extensions).alias("_lang"), "content")
        .where(lang.isin(langs) & (F.length("content") > 0))
        .withColumn("_content", content)
    )
    if skipped is None and any(name in LANGUAGES for name in langs):
        files = files.withColumn("_scan", scanned(F.col("_content"), lang, with_scopes))
        code, numbers, heads = F.coalesce("_scan.code", "_content"), F.col("_scan.numbers"), F.col("_scan.heads")
        files = files.withColumn("_arguments", F.col("_scan.arguments"))
    else:
        patterns = {name: f"(?ms){skipped[name]}" for name in langs if (skipped or {}).get(name)}
        code = F.col("_content")
        if patterns:
            code = F.coalesce(blank_skipped_text(code, _lookup(patterns, "string", lang)), code)
        code = F.regexp_replace(code, r"[ \t\x0B\f]+", " ")
        numbers, heads = F.lit(None).cast("array<int>"), F.lit(None).cast("array<array<int>>")

    def all_hits(file: Column) -> Column:
        def shown(number: Column) -> Column:
            return F.substring(F.get(file["shown"], number), 1, LINE_TEXT_LIMIT)

        def extra(kind: Column, i: Column) -> dict[str, Column]:
            more = {}
            if with_text:
                more["text"] = F.when(kind == "def", shown(F.coalesce(F.get(file["numbers"], i), i)))
            if with_scopes:
                enclosing = F.coalesce(F.get(file["heads"], i), F.array().cast("array<int>"))
                more["scopes"] = F.when(
                    kind == "def", F.transform(enclosing, lambda head: F.struct(head.alias("line"), shown(head).alias("text")))
                )
            return more

        return F.flatten(F.transform(file["found"], lambda rule: _captured(rule, file, extra)))

    pieces = [found.alias("found"), F.col("_numbers").alias("numbers")]
    if with_text or with_scopes:
        pieces.append(F.split("_content", "\n").alias("shown"))
    if with_scopes:
        pieces.append(F.col("_heads").alias("heads"))
    hits = F.col("_hits")
    files = files.withColumns({"_code": code, "_numbers": numbers, "_heads": heads}).withColumn(
        "_hits", _with(F.struct(*pieces), all_hits)
    )
    if backfill:
        source = F.concat_ws(" ", "_code", "_arguments") if "_arguments" in files.columns else F.col("_code")
        more = {}
        if with_text:
            more["text"] = F.lit(None).cast("string")
        if with_scopes:
            more["scopes"] = F.lit(None).cast("array<struct<line:int,text:string>>")
        hits = F.concat(hits, _filled_references(hits, source, _lookup(words, "array<string>", lang), more))
    return files.select("repo_id", "path", hits.alias("hits"))


def tags_of_hits(hits: DataFrame, kind: str | None = None) -> DataFrame:
    """The tags in a table of ``file_hits``, a row for each; of one kind where it is given."""
    found = F.col("hits") if kind is None else F.filter("hits", lambda hit: hit["kind"] == kind)
    # Of a plain column Spark would also filter empty arrays, below the projection that makes it: all the rules, and what is
    # code, would be found three times. A call is taken as it is.
    found = hits.select("repo_id", "path", F.inline(F.flatten(F.array(found))))
    more = [c for c in ("text", "scopes") if c in found.columns]
    return found.select("repo_id", "path", "line", F.explode("names").alias("name"), "kind", *more)


def _filled_references(hits: Column, code: Column, reserved: Column, extra: dict[str, Column]) -> Column:
    """References to every identifier token of the code when ``hits`` holds definitions only."""
    tokens = F.filter(
        F.regexp_extract_all(code, F.lit(IDENTIFIER), F.lit(0)),
        lambda token: ~F.coalesce(F.array_contains(reserved, token), F.lit(False)),
    )
    only_defs = F.exists(hits, lambda t: t["kind"] == "def") & ~F.exists(hits, lambda t: t["kind"] == "ref")
    filled = _hit(F.lit(BACKFILLED_LINE), F.lit("ref"), extra, tokens)
    return F.when(only_defs, F.array(filled)).otherwise(F.slice(hits, 1, 0))


def tag_definitions(files: DataFrame, rules: list[Rule] | None = None, **options) -> DataFrame:
    """``tag_files`` for definitions alone: the rules for references, which match most, are not applied."""
    only = [rule for rule in (RULES if rules is None else rules) if rule.kind == "def"]
    return tag_files(files, only, **{**options, "backfill": False})


def file_symbols(tags: DataFrame) -> DataFrame:
    """Definitions per file, one row each, duplicates kept."""
    return tags.where(F.col("kind") == "def").select("repo_id", "path", "line", "name")


def definition_tags(tags: DataFrame) -> DataFrame:
    """Distinct definition tags per file and name."""
    return file_symbols(tags).distinct()
