"""Text as columns: glossary rules, gluing tokens, wrapping, numbers, redaction, labels."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What takes no blank before it, what takes none after it, and what ends a sentence or a clause.
TIGHT_FIRST, TIGHT_LAST = "'.,!?;:)]}。，！？；：", '([{"'
SENTENCE_MARKS, CLAUSE_MARKS = ".!?;:。！？；：", ",，、"
NO_SPACE_BEFORE = r"^['.,!?;:)\]}。，！？；：]"
NO_SPACE_AFTER = r"[(\[{\"]$"
NUMBER = r"\d+(?:[.,:]\d+)*"


@dataclass(frozen=True)
class Rule:
    """One glossary rule.  ``source`` and ``aliases`` become ``target``; regex targets use ``\\1`` for groups."""

    source: str
    target: str | None = None
    aliases: tuple[str, ...] = ()
    protected: bool = False
    is_regex: bool = False
    case_sensitive: bool = False

    def __post_init__(self) -> None:
        if not self.source.strip():
            raise ValueError("a rule needs a source")
        if self.target is None and not self.protected:
            raise ValueError("only a protected rule may leave its target out")

    @property
    def goal(self) -> str:
        return self.source if self.target is None else self.target

    @property
    def patterns(self) -> tuple[str, ...]:
        """The source, then the trimmed aliases, each once."""
        return tuple(dict.fromkeys([self.source, *[a.strip() for a in self.aliases if a.strip()]]))

    @classmethod
    def of(cls, item: dict) -> Rule:
        """From a mapping, in which ``find`` and ``replace`` may stand for source and target but must not contradict them."""
        both = {}
        for name, old in (("source", "find"), ("target", "replace")):
            values = {v for v in (item.get(name), item.get(old)) if v is not None}
            if len(values) > 1:
                raise ValueError(f"{name} and {old} differ")
            both[name] = values.pop() if values else None
        rest = {k: item[k] for k in ("protected", "is_regex", "case_sensitive") if k in item}
        return cls(both["source"] or "", both["target"], tuple(item.get("aliases") or ()), **rest)


def _template(target: str) -> str:
    """A replacement with ``\\1`` groups in Java's notation."""
    return re.sub(r"\\(\d+)|([$])", lambda m: f"${m[1]}" if m[1] else r"\$", target)


def glossary(text: Column, rules: Sequence[Rule]) -> Column:
    """Rules in order, each rule's patterns in order, each on what the one before left."""
    for rule in rules:
        for pattern in rule.patterns:
            if rule.case_sensitive and not rule.is_regex:
                text = F.replace(text, F.lit(pattern), F.lit(rule.goal))
            else:
                flags = "(?U)" if rule.case_sensitive else "(?iU)"
                text = F.regexp_replace(text, flags + (pattern if rule.is_regex else _quoted(pattern)), _template(rule.goal))
    return text


def _quoted(pattern: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+\-?^$|])", r"\\\1", pattern)


def matches(text: Column, rule: Rule) -> Column:
    """Whether a rule's source or one of its aliases occurs."""
    out = F.lit(False)
    for pattern in rule.patterns:
        if rule.is_regex:
            out = out | text.rlike(("(?U)" if rule.case_sensitive else "(?iU)") + pattern)
        else:
            out = out | contains_term(text, pattern, rule.case_sensitive)
    return out


def contains_term(text: Column, term: str, case_sensitive: bool) -> Column:
    return text.contains(term) if case_sensitive else F.lower(text).contains(term.lower())


def glue(text: Column, token: Column) -> Column:
    """``token`` after ``text``, with a blank unless punctuation forbids it."""
    tight = (text == "") | token.rlike(NO_SPACE_BEFORE) | text.rlike(NO_SPACE_AFTER)
    return F.concat(text, F.when(tight, "").otherwise(" "), token)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), 0)


def wrapped(text: Column, width: int, lines: int) -> Column:
    """Greedy lines of at most ``width`` characters; the last of ``lines`` takes all the rest."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    # Breaks the last line, where it is too long, at its last blank that fits or else after its first word.
    cut = rf"(?<![^\n])(?=[^\n]{{{width + 1},}}\z)([^\n]{{1,{width}}}|[^ \n]+) "
    for _ in range(lines - 1):
        out = F.regexp_replace(out, cut, "$1\n")
    return out


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), 0)


def unspaced(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def plain_token(token: Column) -> Column:
    """A token without non-word characters at its ends, in lower case."""
    return F.lower(F.regexp_replace(token, r"(?U)^\W+|\W+$", ""))


def redacted(text: Column, secrets: Sequence[str], mask: str = "***") -> Column:
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit(mask))
    return text


def size_label(size: Column) -> Column:
    """Bytes with one decimal in B, KB, MB or GB by 1024; null without a positive size."""
    size = size.cast("double")
    out = F.lit(None).cast("string")
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        label = F.concat(F.format_string("%.1f", F.bround(size / 1024.0**power, 1)), F.lit(unit))
        out = F.when(size >= 1024**power if power else size > 0, label).otherwise(out)
    return out


def language_code(name: Column, aliases: dict[str, str]) -> Column:
    key = F.lower(F.trim(name))
    out = key
    for alias, code in aliases.items():
        out = F.when(key == alias, code).otherwise(out)
    return out
