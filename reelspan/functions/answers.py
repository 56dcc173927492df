"""What model answers hold, whatever their form: JSON as VARIANT with repairs, else numbered lines and quoted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.geometry import let
from reelspan.functions.text import is_valid_instruction, stripped

# Kinds of cooperation between two hands.
COOPERATION = "left_then_right right_then_left simultaneous"


def unfenced(text: Column) -> Column:
    """A text without a code fence around it."""

    def inside(t: Column) -> Column:
        at = F.instr(t, "\n")
        body = F.when(at > 0, F.substring(t, at + 1, F.length(t))).otherwise("")
        return F.when(t.startswith("```"), stripped(F.regexp_replace(body, r"(?:^|\n)[ \t]*```[ \t]*$", ""))).otherwise(t)

    return let(stripped(F.coalesce(text, F.lit(""))), inside)


def between(text: Column, first: str, last: str) -> Column:
    """From the first `first` to the last `last`, null where these don't come in this order."""

    def cut(t: Column) -> Column:
        start, end = F.instr(t, first), F.length(t) - F.instr(F.reverse(t), last) + 1
        return F.when((start > 0) & (end > start) & (F.instr(t, last) > 0), F.substring(t, start, end - start + 1))

    return let(text, cut)


def is_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def json_object(text: Column) -> Column:
    """The object (a VARIANT) that an answer is, or that its outermost braces hold; null without one."""
    both = let(unfenced(text), lambda t: F.struct(F.try_parse_json(t).alias("whole"), F.try_parse_json(between(t, "{", "}")).alias("part")))
    return let(both, lambda b: F.when(is_kind(b["whole"], "OBJECT"), b["whole"]).when(is_kind(b["part"], "OBJECT"), b["part"]))


def json_items(text: Column) -> Column:
    """An answer's list of VARIANTs: its array, its object as the only item, else the array that its outermost brackets hold."""
    both = let(unfenced(text), lambda t: F.struct(F.try_parse_json(t).alias("whole"), F.try_parse_json(between(t, "[", "]")).alias("part")))

    def held(b: Column) -> Column:
        whole, part = b["whole"], b["part"]
        items = F.when(is_kind(whole, "ARRAY"), F.try_variant_get(whole, "$", "array<variant>")).when(is_kind(whole, "OBJECT"), F.array(whole))
        return F.coalesce(items, F.when(whole.isNull() & is_kind(part, "ARRAY"), F.try_variant_get(part, "$", "array<variant>")))

    return F.coalesce(let(both, held), F.array().cast("array<variant>"))


def field(item: Column, *names: str) -> Column:
    """The first of some fields that is there and not empty, as text; never null."""
    return F.coalesce(*[F.nullif(F.try_variant_get(item, f"$.{n}", "string"), F.lit("")) for n in names], F.lit(""))


def words(item: Column, many: str, one: str, lower: bool = False) -> Column:
    """A list field, or a single word, or the older field of either form, as trimmed words without empty ones."""

    def form(name: str) -> list[Column]:
        return [F.try_variant_get(item, f"$.{name}", "array<string>"), F.array_compact(F.array(F.try_variant_get(item, f"$.{name}", "string")))]

    listed, single = form(many)
    old, older = form(one)
    held = F.when(F.size(single) > 0, F.coalesce(listed, single)).otherwise(F.coalesce(old, older))
    clean = F.filter(F.transform(held, lambda w: stripped(F.coalesce(w, F.lit("")))), lambda w: w != "")
    return F.transform(clean, lambda w: F.lower(w)) if lower else clean


def instruction(item: Column) -> Column:
    """An instruction's fields from an object, under their present or older names."""
    return F.struct(field(item, "instruction", "instr").alias("instruction"), words(item, "nouns", "noun").alias("nouns"), words(item, "adjectives", "adjective").alias("adjectives"), words(item, "verbs", "verb", True).alias("verbs"))


def listed_instructions(text: Column, most: int) -> Column:
    """The instructions of an answer's JSON, in order, `most` at most; those without a text don't count."""
    objects = F.filter(json_items(text), lambda i: is_kind(i, "OBJECT"))
    return F.slice(F.filter(F.transform(objects, instruction), lambda i: i["instruction"] != ""), 1, most)


def line_instructions(text: Column, most: int) -> Column:
    """The valid instructions of an answer's lines: quoted "instr" fields, or numbered lines of over ten characters."""

    def found(line: Column) -> Column:
        own = stripped(line)
        quoted = F.regexp_extract(own, r'"instr"\s*:\s*"([^"]+)"', 1)
        numbered = F.regexp_extract(own, r"^\d+[.)]\s*(.+)$", 1)
        return F.when(quoted != "", quoted).when(F.length(numbered) > 10, numbered).otherwise("")

    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), found), lambda t: (t != "") & is_valid_instruction(t))
    none = F.array().cast("array<string>")
    return F.slice(F.transform(lines, lambda t: F.struct(t.alias("instruction"), none.alias("nouns"), none.alias("adjectives"), none.alias("verbs"))), 1, most)


def parsed(answers: DataFrame, text: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of `answers` with place (from 0) and the fields of each instruction, and those rows in which none was found."""
    listed = answers.withColumn("_l", listed_instructions(F.col(text), most))
    both = listed.withColumn("_i", F.when(F.size("_l") > 0, F.col("_l")).otherwise(line_instructions(F.col(text), most))).drop("_l")
    found = both.select(*answers.columns, F.posexplode("_i").alias("place", "_f")).select(*answers.columns, "place", "_f.*")
    return found, both.filter(F.size("_i") == 0).drop("_i")


def without_thoughts(text: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>\s*", ""))


def proposed_words(text: Column) -> Column:
    """The words an answer proposes, in lower case; empty without any."""
    bare = F.regexp_replace(without_thoughts(text), r"```(?:json)?\s*", "")
    held = F.try_variant_get(F.try_parse_json(between(bare, "{", "}")), "$.words", "array<string>")
    clean = F.transform(F.coalesce(held, F.array().cast("array<string>")), lambda w: F.lower(stripped(F.coalesce(w, F.lit("")))))
    return F.filter(clean, lambda w: w != "")


def two_hands(text: Column) -> Column:
    """left, right and kind of an answer that splits a task between hands; null if a part is missing or the kind unknown."""

    def parts(item: Column) -> Column:
        left, right = (stripped(field(item, f"{h}_instruction")) for h in ("left", "right"))
        return F.struct(left.alias("left"), right.alias("right"), F.lower(stripped(field(item, "coordination_type"))).alias("kind"))

    ok = lambda p: (p["left"] != "") & (p["right"] != "") & p["kind"].isin(COOPERATION.split())
    return let(let(json_object(text), parts), lambda p: F.when(ok(p), p))
