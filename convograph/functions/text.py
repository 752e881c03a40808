"""Text expressions inside code generation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Greetings and acknowledgments that carry nothing to extract.
GREETINGS = [
    "hi", "hello", "hey", "good morning", "good night", "morning", "night", "gm", "gn", "lol", "haha", "ok", "okay", "yes", "no",
    "thanks", "thank you", "thx", "你好", "您好", "在吗", "早上好", "晚上好", "晚安", "哈哈", "哈哈哈", "好的", "嗯", "嗯嗯", "哦",
    "谢谢", "感谢", "收到", "+1",
]
# Words that are no candidate terms.
STOPWORDS = (
    "the a an is are was were to of in on and or it this that i you we they he she do does did not no yes what who how when where why can "
    "could would should will for with at by from as be been have has had so but if then just me my your our their its about there here ok "
    "okay yeah hi hello hey thanks thank"
).split()
# Relationship names that are kept for the system.
RESERVED = ["contains", "known_as", "also_known_as", "is_a", "supersedes"]
CJK_RUN = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
CJK_COUNTED = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"


def fold_ascii(text: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(text, UPPER, LOWER)


def contains_literal(text: Column, term: Column) -> Column:
    """Literal substring search that folds ASCII case only; a blank term finds nothing."""
    return (F.trim(term) != "") & (F.instr(fold_ascii(text), fold_ascii(term)) > 0)


def insubstantial(text: Column) -> Column:
    """No letter or digit at all, or a greeting once outer punctuation is gone."""
    t = F.lower(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    bare = F.regexp_replace(t, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")
    return ~F.coalesce(text, F.lit("")).rlike(r"[\p{IsAlphabetic}\p{N}]") | t.isin(GREETINGS) | ((bare != "") & bare.isin(GREETINGS))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != ""))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK_COUNTED))


def excerpt(text: Column, n: int = 60) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def escape_text(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_attribute(text: Column) -> Column:
    return F.replace(escape_text(text), F.lit('"'), F.lit("&quot;"))
