"""Column functions over text: prose variants, words, tokens, labels.

All are plain Catalyst expressions.  A null text gives null unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import patterns as P


def visible_text(content: Column | str = "message.content") -> Column:
    """The text blocks of a message, joined by newlines, without outer white space; '' without any."""
    c = F.col(content) if isinstance(content, str) else content
    texts = F.transform(F.filter(c, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.coalesce(trimmed(F.array_join(texts, "\n")), F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def analysis_prose(c: Column) -> Column:
    """Without fences, inline code, quoted lines, links, paths and tags."""
    for p in (r"(?s)```.*?```", r"`[^`\n]+`", r"(?m)^\s*>.*$", r"https?://\S+", r"(?:^|\s)[~.]?/[^\s,;:]+", r"<[^>\n]+>"):
        c = F.regexp_replace(c, p, " ")
    return one_space(c)


def tone_prose(c: Column, tags: bool = True) -> Column:
    """Without fences, inline code, links, home paths and, with ``tags``, tags."""
    steps = [r"(?s)```.*?```", r"`[^`\n]+`", r"https?://\S+", r"\[[^\]]+\]\([^\)]+\)", r"(?:/Users/|/home/)[^\s,;:]+"]
    for p in [*steps, r"<[^>\n]+>"] if tags else steps:
        c = F.regexp_replace(c, p, " ")
    return one_space(c)


def placeholder_prose(c: Column) -> Column:
    """Code, links and paths replaced by a note that they were removed; names of commands in backticks stay, quoted lines go."""
    steps = [
        (r"(?s)```.*?```", " content removed locally "), (r"`([^`\n]+)`", "\x02$1\x03"), (rf"\x02(?i)((?!{P.UNSAFE_COMMAND}){P.SAFE_COMMAND})\x03", " `$1` "), (r"\x02[^\x03]*\x03", " content removed locally "),
        (r"(?m)^\s*>.*$", " "), (r"https?://\S+", " link removed locally "), (r"\[[^\]]+\]\([^\)]+\)", " link removed locally "),
        (r"(^|[\s(\"'`])(?:[A-Za-z]:)?[/.~][^\s,;:]+", "$1 path removed locally "), (r"<[^>]+>", " "),
    ]
    for p, note in steps:
        c = F.regexp_replace(c, p, note)
    return one_space(c)


def phrase_prose(c: Column) -> Column:
    """For phrase mining: without fences, backtick spans over lines, links and home paths."""
    for p in (r"(?s)```.*?```", r"(?s)`[^`]*`", r"https?://\S+", r"\[[^\]]+\]\([^\)]+\)", r"(?:/Users/|/home/)[^\s,;:]+"):
        c = F.regexp_replace(c, p, " ")
    return c


def family_prose(c: Column) -> Column:
    """For families of phrases: as for phrase mining, but paths leave a mark and names in the genitive become a person's."""
    for p, r in ((r"(?s)```.*?```", " "), (r"(?s)`[^`]*`", " "), (r"https?://\S+", " "), (r"\[[^\]]+\]\([^\)]+\)", " "), (r"(?:/Users/|/home/)[^\s,;:]+", " [path] "), (r"(?<![0-9A-Za-z_])[A-Z][a-z]{2,}[’']s(?![0-9A-Za-z_])", "person's")):
        c = F.regexp_replace(c, p, r)
    return c


def opening_prompt(c: Column) -> Column:
    """What a person asked: behind a heading for the request if there is one, without what clients add."""
    c = F.coalesce(F.nullif(F.regexp_extract(c, r"(?is)(?:^|\n)## My request:\s*(.*)$", 1), F.lit("")), F.regexp_replace(c, r"(?is)(?:^|\n)## My request:\s*$", ""))
    for tag in P.CLIENT_TAGS:
        c = F.regexp_replace(c, rf"(?is)<{tag}>.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?im)^\s*# AGENTS\.md instructions\s*$", " ")
    return one_space(F.regexp_replace(c, r"(?is)<image(?![0-9A-Za-z_])[^>]*>.*?</image>", " "))


def neutral(c: Column) -> Column:
    """Marks of redaction in words."""
    return one_space(F.regexp_replace(c, r"(?i)\[(?:REDACTED|REMOVED)[^\]]*\]", "sensitive value removed locally"))


def trajectory_safe(c: Column, most: int = 600) -> Column:
    """Whether a text may stand in a trajectory that others see."""
    return share_safe(c, 2, most, 40)


#: Characters whose compatibility form holds ASCII letters or digits: full width, ligatures, letterlike and enclosed ones.
_COMPATIBLE = "".join(chr(o) for o in range(0x80, 0x3400) if (n := unicodedata.normalize("NFKC", chr(o))) != chr(o) and re.search("[A-Za-z0-9']", n)) + "".join(chr(o) for o in range(0xFB00, 0xFB07)) + "".join(chr(o) for o in range(0xFF01, 0xFF5F))


def _ranges(chars: str, gap: int = 1) -> str:
    """A class of characters as ranges, over gaps of less than ``gap``: a class is tried one range after another."""
    out: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if out and o - out[-1][1] <= gap:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


#: Most letters beyond ASCII are in none of the few wide ranges and so never tried against the many narrow ones.
_HOLDS_COMPATIBLE = f"(?={_ranges(_COMPATIBLE, 100)}){_ranges(_COMPATIBLE)}"


def nfkc(c: Column) -> Column:
    """Compatibility forms of letters and digits as plain ones; only texts that hold any go through Python."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    # The class is only tried on texts beyond ASCII, which are few.
    return F.coalesce(normal(F.when(c.rlike(r"[^\x00-\x7f]") & c.rlike(_HOLDS_COMPATIBLE), c)), c)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(P.WORD))


def sentences(c: Column) -> Column:
    """Sentences of a text: cut after . ! ? with white space behind, and at newlines."""
    return F.filter(F.split(F.regexp_replace(c, r"([.!?。！？])\s+|\n+", "$1" + "\x01"), "\x01"), lambda s: s != "")


def clauses(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"[;:—–]|,\s+(?=(?:and|but|or|so|yet)\s)", "\x01"), "\x01"), lambda s: F.trim(s) != "")


def tokens(c: Column) -> Column:
    """Lower-case English words with an inner apostrophe."""
    return F.regexp_extract_all(F.lower(F.translate(c, "’‘", "''")), F.lit(r"[a-z]+(?:'[a-z]+)?"), F.lit(0))


def mining_tokens(c: Column) -> Column:
    """Tokens with numbers as {number} and redaction words as {redacted}."""
    found = F.regexp_extract_all(F.lower(F.translate(c, "’‘", "''")), F.lit(r"[a-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?"), F.lit(0))
    return F.transform(
        found, lambda t: F.when(t.rlike("^[0-9]"), "{number}").when(t.isin("redacted", "credential", "secret"), "{redacted}").otherwise(t)
    )


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(c.rlike(P.java(pattern, ignore_case)), F.lit(False))


def occurrences(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(c, F.lit(P.java(pattern, ignore_case)))


def is_frustrated(text: Column) -> Column:
    p = tone_prose(text, tags=False)
    caps = F.filter(F.regexp_extract_all(p, F.lit(P.java(r"\b[A-Z]{4,}\b")), F.lit(0)), lambda w: ~w.isin(P.ACRONYMS))
    return (p != "") & (matches(p, P.FRUSTRATION) | (((F.size(caps) >= 2) | p.rlike("[!?]{3,}")) & matches(p, P.NEGATIVE_TONE)))


def is_grateful(text: Column) -> Column:
    return matches(tone_prose(text, tags=False), P.GRATITUDE)


def share_safe(c: Column, least: int, most: int, base64_run: int | None = 40, secret: int = 12) -> Column:
    """Whether a text may be shown: length, no control characters, links, home paths, code, tags, marks of redaction, mail addresses, labelled secrets, long runs of base64."""
    bad = [
        r"[\x00-\x1f\x7f]", r"(?i:https?://|/Users/|/home/|```|<[^>]+>|\[(?:REDACTED|REMOVED)[^\]]*\])", r"(?i:[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})",
        rf"(?i:\b(?:sk|gh[oprsu]|token|secret|key)[-_=:][A-Za-z0-9_-]{{{secret},}})",
    ]
    if base64_run:
        bad.append(rf"\b[A-Za-z0-9+/]{{{base64_run},}}={{0,2}}\b")
    # One expression, as the text may itself be a long one.
    return F.coalesce(F.length(c).between(least, most) & ~c.rlike(P.java("|".join(bad))), F.lit(False))


def ellipsis(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word."""
    cut = F.regexp_replace(F.substring(c, 1, most - 1), r"\s+\S*$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def model_name(c: Column) -> Column:
    """A readable name of a model id; 'Unknown model' for null."""
    raw = F.coalesce(c, F.lit("Unknown model"))
    claude, gpt = r"(?i)^claude-([a-z]+)-(\d+)-(\d+)$", r"(?i)^gpt-(\d+)[.-](\d+)(?:-([a-z]+))?$"
    tail = F.regexp_extract(raw, gpt, 3)
    return (
        F.when(c.isNull(), "Unknown model")
        .when(raw == "<synthetic>", "Synthetic model")
        .when(raw.rlike(claude), F.concat(F.lit("Claude "), F.initcap(F.regexp_extract(raw, claude, 1)), F.lit(" "), F.regexp_extract(raw, claude, 2), F.lit("."), F.regexp_extract(raw, claude, 3)))
        .when(raw.rlike(gpt), F.concat(F.lit("GPT-"), F.regexp_extract(raw, gpt, 1), F.lit("."), F.regexp_extract(raw, gpt, 2), F.when(tail != "", F.concat(F.lit(" "), F.initcap(tail))).otherwise("")))
        .otherwise(F.initcap(F.regexp_replace(raw, "-", " ")))
    )


def agent_name(c: Column) -> Column:
    out = F.lit("Claude Code")
    for k, v in P.AGENTS:
        out = F.when(c == k, v).otherwise(out)
    return out


def project_name(path: Column) -> Column:
    """The last part of a path as a title: words begin with a capital, the rest of them stays."""
    words = F.split(F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), "[-_.]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def tool_label(c: Column) -> Column:
    """A tool's name in plain characters, at most 48."""
    plain = F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("Unknown tool")), r"[^A-Za-z0-9_. -]", "")), 1, 48)
    return F.when(plain == "", "Unknown tool").otherwise(plain)


def opaque_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def _cascade(c: Column, rules: list[tuple], value: int) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(c.rlike(P.java(rule[0], True)), F.lit(rule[value])).otherwise(out)
    return out


def command_of(arguments: Column) -> Column:
    """The command of a tool's JSON arguments, '' without one."""
    return F.coalesce(F.get_json_object(arguments, "$.cmd"), F.get_json_object(arguments, "$.command"), F.lit(""))


def hinted(semantics: Column, action: Column, method: Column) -> Column:
    """Semantics a record already names, where both are known ones, else those given."""
    known = (action.isNull() | action.isin(P.ACTIONS)) & F.coalesce(method.isin(P.METHODS), F.lit(False))
    return F.when(known, F.struct(action.alias("action"), method.alias("method"))).otherwise(semantics)


def tool_semantics(name: Column, arguments: Column) -> Column:
    """struct(action, method) of a tool call, from its name or its command."""
    tool, command = F.lower(F.coalesce(name, F.lit(""))), F.regexp_replace(command_of(arguments), r"(?i)\\[nrt]", " ")
    hides = command.rlike(r"(?i)\.gitignore(?![0-9A-Za-z_])")
    edits = F.struct(F.when(hides, "hide").otherwise("edit").alias("action"), F.lit("file_edit").alias("method"))
    by_brew = F.when((_cascade(command, P.COMMANDS, 1) == "download") & command.rlike(P.java(P.BREW, True)), "package_manager")
    found = F.struct(_cascade(command, P.COMMANDS, 1).alias("action"), F.coalesce(by_brew, _cascade(command, P.COMMANDS, 2), F.when(command == "", "unknown").otherwise("shell")).alias("method"))
    pair = lambda a, m: F.struct(F.lit(a).alias("action"), F.lit(m).alias("method"))
    return (
        F.when(tool.isin("read", "read_file"), pair("read", "builtin_read"))
        .when(tool.isin("write", "write_file"), pair("write", "builtin_write"))
        .when(tool.isin("edit", "apply_patch", "multiedit"), edits)
        .when(command.rlike(P.java(P.COMMANDS[1][0], True)) & ~command.rlike(P.java(P.COMMANDS[0][0], True)), edits)
        .otherwise(found)
    )


def restriction(c: Column, sudo: bool = False) -> Column:
    """The canonical phrase of what stopped a tool, null if nothing did."""
    rules = list(P.RESTRICTIONS)
    if sudo:
        rules.insert(4, P.SUDO_RESTRICTION)
    return _cascade(c, rules, 1)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.78, "High").when(score >= 0.56, "Medium").otherwise("Low")


def repaired_json(c: Column) -> Column:
    """A JSON object in a reply: as it is, out of a fence, or between the outermost braces; null if none parses."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.when(F.try_parse_json(x).isNotNull() & x.rlike(r"^\s*\{"), trimmed(x)) for x in (c, fenced, braces)))


def token_distance(a: Column, b: Column, most: Column | int) -> Column:
    """Edit distance of two token arrays, -1 above ``most``.

    Each distinct token becomes one character, so the built-in character distance counts tokens.
    """
    words = F.array_distinct(F.concat(a, b))
    code = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, t) + 65535), 8, "0")), "UTF-32")
    as_text = lambda x: F.array_join(F.transform(x, code), "")
    limit = F.lit(most) if isinstance(most, int) else most.cast("int")
    pair = F.array(F.struct(as_text(a).alias("x"), as_text(b).alias("y")))
    return F.element_at(F.transform(pair, lambda p: F.call_function("levenshtein", p["x"], p["y"], limit)), 1)


def contains_tokens(outer: Column, inner: Column) -> Column:
    sp = F.lit(" ")
    return F.concat(sp, F.array_join(outer, " "), sp).contains(F.concat(sp, F.array_join(inner, " "), sp))
