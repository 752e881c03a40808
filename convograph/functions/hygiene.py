"""Cleaning text that a model wrote: reasoning, reply fences, lines that repeat the tags of its input. Each is one scan from left to right.

``*_text`` are functions of one string, the others run them over a column in Arrow batches; null stays null."""
from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tags of rendered context and of reasoning.
REGIONS = (("<summary", "</summary>"), ("<memory", "</memory>"), ("<msg", "</msg>"), ("<you", "</you>"), ("<media", "</media>"))
THINK = re.compile(r"<think>|</think>")


def strip_reasoning_text(text: str) -> str:
    """The text without what stands between reasoning tags. The first closing tag ends a region; a closing tag without an opening one drops all
    before it, and an opening one without a closing one all behind it."""
    out, kept_from, inside = [], 0, False
    for tag in THINK.finditer(text):
        if tag[0] == "<think>":
            if not inside:
                out.append(text[kept_from:tag.start()])
                inside = True
        elif inside:
            inside, kept_from = False, tag.end()
        else:
            # only what was kept since the last region is a tail of reasoning
            kept_from = tag.end()
    if not inside:
        out.append(text[kept_from:])
    return "".join(out)


def _opener(tag: str) -> re.Pattern:
    # a longer name that begins alike is no tag; an attribute ends at the first sign that closes
    return re.compile(rf"<{re.escape(tag)}(?=[>\s])[^>]*>")


def extract_fence_text(text: str, tag: str) -> str:
    """The inside of the first complete fence, or the text as it is."""
    m = _opener(tag).search(text)
    end = text.find(f"</{tag}>", m.end()) if m else -1
    return text[m.end():end] if m and end >= 0 else text


def fence_line(line: str, tag: str) -> str | None:
    """A line without fence tags: complete pairs are unwrapped as often as there are any, tags at either end go, and a line that was only a tag is none."""
    close, opener = f"</{tag}>", _opener(tag)
    if f"<{tag}" not in line and close not in line:
        return line
    bare = line.strip()
    m = opener.match(bare)
    if bare == close or m and not bare[m.end():].strip():
        return None
    while True:
        parts, at, changed = [], 0, False
        while m := opener.search(line, at):
            end = line.find(close, m.end())
            if end < 0:
                break
            parts += [line[at:m.start()], line[m.end():end]]
            at, changed = end + len(close), True
        if not changed:
            break
        line = "".join([*parts, line[at:]])
    while True:
        head = line.lstrip()
        m = opener.match(head)
        n = len(close) if head.startswith(close) else m.end() if m else 0
        if not n:
            break
        line = line[:len(line) - len(head)] + head[n:]
    while True:
        tail = line.rstrip()
        last = tail.rfind("<")
        if tail.endswith(close):
            line = tail[:-len(close)]
        elif tail.endswith(">") and last >= 0 and opener.fullmatch(tail, last):
            line = tail[:last]
        else:
            break
    return line if line.strip() else None


def filter_lines_text(text: str, tag: str) -> str:
    """The text without lines that repeat its input: regions that open at the start of a line up to the line of their end, lines that begin with
    an end, and fence tags."""
    kept, until = [], None
    for raw in text.split("\n"):
        line = fence_line(raw.removesuffix("\r"), tag)
        if line is None:
            continue
        start = line.lstrip()
        if until:
            until = None if until in start else until
            continue
        region = next((r for r in REGIONS if start.startswith(r[0]) and (start[len(r[0]):len(r[0]) + 1] or ">") in "> \t"), None)
        if region:
            until = None if region[1] in start else region[1]
        elif not any(start.startswith(end) for _, end in REGIONS):
            kept.append(line)
    return "\n".join(kept).strip()


def _column(f: Callable[[str], str]) -> Callable[[Column], Column]:
    def apply(text: Column) -> Column:
        @F.pandas_udf(T.StringType())
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

        return run(text)

    return apply


def strip_reasoning(text: Column) -> Column:
    return _column(strip_reasoning_text)(text)


def extract_fence(text: Column, tag: str) -> Column:
    return _column(lambda t: extract_fence_text(t, tag))(text)


def filter_lines(text: Column, tag: str) -> Column:
    return _column(lambda t: filter_lines_text(t, tag))(text)


def speech_tag(name: Column) -> Column:
    """The tag the bot speaks under: its name in lower case, letters, digits, _ and - only, or "you"."""
    t = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9_-]", "")
    return F.when(t == "", "you").otherwise(t)


def display_name(first: Column, last: Column, username: Column, user_id: Column) -> Column:
    """First and last name if there is a last one, otherwise @username, otherwise the id."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(~blank(last), F.concat_ws(" ", first, last)).when(~blank(username), F.concat(F.lit("@"), username)).otherwise(user_id)


def valid_chat_id(chat_id: Column) -> Column:
    """A chat id that may name a folder: not empty, without separators, NUL or two points."""
    return F.coalesce(~chat_id.rlike(r"[/\\\x00]|\.\.") & (chat_id != ""), F.lit(False))


def trusted_media(text: Column) -> Column:
    """Text escaped but for complete media elements whose attributes hold no "<" and whose caption neither "<" nor ">". From the first element
    that is none on, everything is escaped."""
    from .text import escape_text

    opener, close = F.lit("<media "), "</media>"

    def step(acc: Column, piece: Column) -> Column:
        end = F.instr(piece, F.lit(close))
        inside = F.substring(piece, F.lit(1), F.greatest(end - 1, F.lit(0)))
        gt = F.instr(inside, F.lit(">"))
        attributes, caption = F.substring(inside, F.lit(1), F.greatest(gt - 1, F.lit(0))), F.substring(inside, gt + 1, F.length(inside))
        fine = (end > 0) & (gt > 0) & ~attributes.contains("<") & ~caption.contains("<") & ~caption.contains(">")
        behind = F.substring(piece, end + len(close), F.length(piece))
        raw = F.concat(opener, inside, F.lit(close), escape_text(behind))
        stop = acc["stop"] | ~fine
        return F.struct(F.concat(acc["out"], F.when(stop, escape_text(F.concat(opener, piece))).otherwise(raw)).alias("out"), stop.alias("stop"))

    pieces = F.split(text, "<media ")
    first = F.struct(escape_text(pieces[0]).alias("out"), F.lit(False).alias("stop"))
    out = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), first, step, lambda acc: acc["out"])
    return F.when(text.contains("<media "), out).otherwise(escape_text(text))
