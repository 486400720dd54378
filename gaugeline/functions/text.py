"""Text and value functions: normalising, classifying, segmenting, comparing, parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HEBREW = "\\u0590-\\u05FF"
#: White space of all scripts, for a pattern's class.
SPACE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def strip_between_hebrew(text: Column) -> Column:
    """Drops : and . that stand between two Hebrew letters."""
    return F.regexp_replace(text, f"(?<=[{HEBREW}])[:.](?=[{HEBREW}])", "")


def loose_pattern(phrase: str, gap: str = r"[\s\p{Punct}]{0,2}") -> str:
    """A pattern for a phrase whose letters extraction may have pulled apart."""
    letters = [c for c in phrase if not c.isspace()]
    return gap.join("\\" + c if not c.isalnum() else c for c in letters)


def space_at_digit_borders(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?U)(\p{L})(\d)", "$1 $2")
    return F.regexp_replace(text, r"(?U)(\d)(\p{L})", "$1 $2")


def normalised(text: Column) -> Column:
    """Straight quotes, single spaces, no ends."""
    straight = F.translate(text, "“”„’‘׳״″", "\"\"\"'''\"\"")
    return F.trim(F.regexp_replace(straight, r"\s+", " "))


def without_qualifiers(text: Column) -> Column:
    """No parentheses, no tail after a hyphen or dash between spaces, or after a comma."""
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), f"[{SPACE}]+", " "))
    text = F.regexp_replace(text, f"[{SPACE}]+[-\u2013\u2014][{SPACE}]+.*$", "")
    return F.trim(F.substring_index(text, ",", 1))


def squashed(text: Column) -> Column:
    """Letters of any script, without separators; null where nothing is left, so that it matches nothing."""
    return F.nullif(F.regexp_replace(text, f"[{SPACE},/().\\-\u2013\u2014]+", ""), F.lit(""))


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def replacements(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """How often replaced() replaces something: each pair's hits in the text as the pairs before it left it."""
    hits, left = F.lit(0).cast("long"), text
    for old, new in pairs:
        cut = F.length(left) - F.length(F.replace(left, F.lit(old), F.lit("")))
        hits, left = hits + (cut / len(old)).cast("long"), F.replace(left, F.lit(old), F.lit(new))
    return hits


def by_method(df, keys: list[str], methods: tuple[str, ...], handlers: dict[str, Column]):
    """(keys, method, verdict): every method's handler on every row; a method must have one."""
    if lost := set(methods) - set(handlers):
        raise ValueError(f"no handler for {sorted(lost)}")
    return df.select(*keys, *(handlers[m].alias(m) for m in methods)).unpivot(keys, list(methods), "method", "verdict")


def tokens(text: Column) -> Column:
    """Words of any script, cut at separators only."""
    return F.array_distinct(F.filter(F.split(text, f"[{SPACE},/()]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def script_share(text: Column, letters: str, every: str) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit(letters)).cast("double"), F.regexp_count(text, F.lit(every)))


def first_number(text: Column) -> Column:
    got = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1)
    return F.nullif(got, F.lit("")).try_cast("double")


def number_range(text: Column) -> Column:
    low = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)", 1)
    high = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)", 2)
    return F.struct(F.nullif(low, F.lit("")).try_cast("double").alias("low"), F.nullif(high, F.lit("")).try_cast("double").alias("high"))


def whole(value: Column) -> Column:
    """A whole number, or null."""
    return F.when(value == F.floor(value), value.cast("long"))


def plot_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"^plot_(\d+)$", 1), F.lit("")).try_cast("int")


def first_class(text: Column, classes: list[tuple[str, str]], other: str) -> Column:
    """The first class, in order, whose pattern occurs."""
    out = F.when(F.lit(False), F.lit(other))
    for name, pattern in classes:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def earliest(text: Column, words: list[str], width: int = 120) -> Column:
    """struct(at, word, span) of the word that occurs first; ties by the words' order."""
    hits = F.filter(F.array(*(F.struct(F.instr(text, F.lit(w)).alias("at"), F.lit(i).alias("i"), F.lit(w).alias("word")) for i, w in enumerate(words))), lambda h: h["at"] > 0)
    best = F.array_min(hits)
    return F.struct(best["at"].alias("at"), best["word"].alias("word"), F.substr(text, best["at"], F.lit(width)).alias("span"))


def capped(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def html_escaped(text: Column) -> Column:
    return replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def section_key(section: Column) -> Column:
    """"2.10" as [2, 10]: arrays compare element by element."""
    return F.transform(F.split(section, r"\."), lambda x: x.try_cast("int"))


def next_revision(version: Column) -> Column:
    """A trailing number goes up by one; without one, -r2 is added."""
    tail = F.regexp_extract(version, r"(\d+)$", 1)
    return F.when(tail != "", F.concat(F.regexp_replace(version, r"\d+$", ""), (tail.try_cast("long") + 1).cast("string"))).otherwise(F.concat(version, F.lit("-r2")))


def canonical_version(version: Column) -> Column:
    """v<bare>, or null where the rest is unsafe in a path."""
    bare = F.regexp_replace(F.lower(F.trim(version)), "^v", "")
    return F.when(bare.rlike(r"^[a-z0-9][a-z0-9._-]*$") & ~F.contains(bare, F.lit("..")), F.concat(F.lit("v"), bare))


def iso_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("d/M/yyyy")))


def appended(notes: Column, note: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n\n", blank(notes), blank(note))


def terse(text: Column, most: int = 120) -> Column:
    """The first clause: up to the first sentence end, semicolon or dash, at most `most` characters."""
    clause = F.substring_index(F.substring_index(F.substring_index(F.trim(text), ". ", 1), ";", 1), " - ", 1)
    return F.substring(F.regexp_replace(F.trim(clause), r"\.$", ""), 1, most)


def compound_plots(label: Column) -> Column:
    """Plot numbers of a label such as "3+4" or "3, 4/5"; null where a part is no number."""
    parts = F.filter(F.transform(F.split(label, r"[+,/&]"), lambda p: F.trim(p)), lambda p: p != "")
    good = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"^\d+$"))
    return F.when(good, F.transform(parts, lambda p: p.try_cast("int")))


def self_evident(label: Column, known: list[str]) -> Column:
    """All words of a label are known ones or numbers."""
    words = F.filter(F.split(F.lower(label), r"[^\p{L}\d]+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*known) | w.rlike(r"^\d+$"))


def decision_basis(verdict: Column, n_findings: Column) -> Column:
    return (
        F.when((verdict == "rejected") & (n_findings > 0), "substantive").when(verdict == "rejected", "unexplained")
        .when((verdict == "approved") & (n_findings > 0), "conditional").when(verdict == "approved", "clean").otherwise("unknown")
    )


def score(parts: list[tuple[Column, float]]) -> Column:
    """Weights of the conditions that hold, summed and kept within 0 and 1."""
    total = reduce(lambda a, b: a + b, (F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in parts))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def without_suffixes(name: Column, suffixes: list[str]) -> Column:
    """Suffixes taken off one after another; the original where nothing is left."""
    short = reduce(lambda n, s: F.regexp_replace(n, r"[\s,]*" + s + r"\.?\s*$", ""), suffixes, name)
    return F.coalesce(F.nullif(F.trim(short), F.lit("")), name)


def percent_delta(value: Column, base: Column) -> Column:
    """Null where the base is zero or either is not a number."""
    good = ~F.isnan(value.cast("double")) & ~F.isnan(base.cast("double"))
    return F.when(good, F.try_divide((value - base).cast("double"), F.nullif(base.cast("double"), F.lit(0.0))) * 100)


def layout_fields(text: Column, layouts: dict[str, dict[str, list[str]]]) -> Column:
    """struct(layout, <field> ...) by a table of layouts, fields and patterns, whose first group is the value.

    Each layout fills what fields it can, each by the first of its patterns that matches; the layout with most fields filled
    is the document's (ties: the first), and fields that it leaves empty fall back to the other layouts, in their order.
    Without any field the layout is null."""
    names = list(dict.fromkeys(f for fields in layouts.values() for f in fields))

    def first(patterns: list[str]) -> Column:
        found = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    filled = F.array(*(F.struct(F.lit(n).alias("layout"), F.lit(-i).alias("order"), *(first(fields.get(f, [])).alias(f) for f in names)) for i, (n, fields) in enumerate(layouts.items())))
    some = lambda s: sum((s[f].isNotNull().cast("int") for f in names), F.lit(0))
    # most filled first, then as given
    sorted_ = F.array_sort(filled, lambda a, b: F.when(some(a) != some(b), some(b) - some(a)).otherwise(b["order"] - a["order"]))
    pick = lambda s: F.struct(F.when(some(s[0]) > 0, s[0]["layout"]).alias("layout"), *(F.coalesce(*(s[i][f] for i in range(len(layouts)))).alias(f) for f in names))
    return F.transform(F.array(sorted_), pick)[0]
