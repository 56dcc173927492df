"""Text columns: normal forms, validity rules and hand instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs that may begin an instruction, prepositions of place, words of direction beside them, and colours.
VERBS = "pick grasp place push pull slide open close rotate turn lift lower press tap move align insert remove unscrew screw flip twist unfold fold"
PREPOSITIONS = "on, onto, in, into, inside, near, next to, beside, by, between, to the left of, to the right of, above, below, against, at, over, under, in front of, behind, around, top of"
DIRECTIONS = "toward, towards, away from, closer to, farther from, to the left, to the right, leftward, rightward, forward, backward, aside, across"
COLOURS = "red green blue yellow orange purple pink black white gray grey brown cyan magenta gold silver beige maroon violet indigo turquoise navy olive teal lime ivory bluish reddish"

# Words that are no slot words, endings of nouns, food and surface nouns, and openings of augmented texts.
STOPWORDS = """a an the it its is am are was were be on in at to by of and or but not no do did has had have can may will shall
this that then than from with into onto for near beside next between under over above below up down out off away back here there where
each every some any all both other another"""
NOUN_ENDINGS = "tion ness ment ity ure age ance ence er or ist ian ism dom ship hood"
FOODS = "food vegetable fruit cheese bread meat substance ingredient onion tomato carrot herb"
FOOD_MARKS = "food substance ingredient sliceable"
SURFACES = "cutting_board board plate bowl dish tray mat"
OPENINGS = [
    "双手从画面下方伸入画面[。.]?",
    "人物使用双手协同完成动作[：:]",
    "右手从画面右下角伸入画面[。.]?",
    "左手从画面左下角伸入画面[。.]?",
    "人物仅使用右手完成动作[：:]",
    "人物仅使用左手完成动作[：:]",
    "(?i:Both hands enter from the bottom of the frame)[.]?",
    "(?i:The person uses both hands cooperatively)[：:]",
    "(?i:The (?:RIGHT|LEFT) hand enters from the bottom-(?:right|left) of the frame)[.]?",
    "(?i:Only the (?:RIGHT|LEFT) hand is used)[：:]",
]


def alternatives(words: str) -> str:
    """A group of the words, or of the phrases where commas part them."""
    return "(?:" + "|".join(words.split(", ") if "," in words else words.split()) + ")"


PLACED = rf"\bplace\b.+\b{alternatives(PREPOSITIONS)}\b"
DIRECTED = rf"\b{alternatives(PREPOSITIONS + ', ' + DIRECTIONS)}\b"


def normalise(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def is_valid_instruction(text: Column) -> Column:
    """At least eight characters, no '-then-place', a known verb first, and what place and the moving verbs need.

    place needs a preposition of place after it; move, push, pull and slide need such a
    preposition or a word of direction anywhere.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")

    def has(pattern: str) -> Column:
        return t.rlike("(?i)" + pattern)

    placed = ~has(r"\bplace\b") | has(PLACED)
    directed = ~has(r"\b(?:move|push|pull|slide)\b") | has(DIRECTED)
    return (F.length(t) >= 8) & ~has(r"\b(?:pick|grasp)-then-place\b") & has(rf"^{alternatives(VERBS)}\b") & placed & directed


def format_hands(left: Column, right: Column) -> Column:
    """'Left hand: X. Right hand: Y.' with None for what is missing or blank."""

    def clause(text: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.trim(text), r"[.]+$", ""))
        return F.coalesce(F.nullif(bare, F.lit("")), F.lit("None"))

    return F.concat(F.lit("Left hand: "), clause(left), F.lit(". Right hand: "), clause(right), F.lit("."))


def parse_hand(text: Column, hand: str) -> Column:
    """One hand's clause, without its full stop; null where it is missing or 'none'."""
    end = r"\.?\s*(?:right hand:|$)" if hand == "left" else r"\.?\s*$"
    found = F.trim(F.regexp_extract(text, rf"(?is){hand} hand:\s*(.*?){end}", 1))
    return F.when((found != "") & (F.lower(found) != "none"), found)


def has_colour(text: Column) -> Column:
    return F.lower(text).rlike(rf"\b{alternatives(COLOURS)}\b")


def swap_sides(text: Column) -> Column:
    """A mirrored instruction: left and right exchanged wherever they stand but in upright and leftover.

    The left hand's clause then comes first again, and what stood before both clauses goes. A text
    without one of the clauses is only exchanged.
    """
    out = text
    for old, new in (("upright", "\u0001"), ("leftover", "\u0002"), ("Left", "\u0003"), ("Right", "Left"), ("\u0003", "Right"), ("left", "\u0003"), ("right", "left"), ("\u0003", "right")):
        out = F.replace(out, F.lit(old), F.lit(new))
    left, right = F.instr(out, "Left hand:"), F.instr(out, "Right hand:")

    def clause(first: Column, then: Column) -> Column:
        part = F.when(first < then, F.substring(out, first, then - first)).otherwise(F.substring(out, first, F.length(out)))
        return F.regexp_replace(part, r"^\s+|\s+$", "")

    ordered = F.when((left > 0) & (right > 0), F.concat_ws(" ", clause(left, right), clause(right, left))).otherwise(out)
    return F.replace(F.replace(ordered, F.lit("\u0001"), F.lit("upright")), F.lit("\u0002"), F.lit("leftover"))


def merge_lists(*parts: Column) -> Column:
    """Comma lists (plain or full-width commas) as one, first mentions kept in order."""
    items = F.transform(F.split(F.concat_ws(",", *parts), "[,，]"), lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.filter(items, lambda x: x != "")), ", ")


def safe_label(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")


def json_in(text: Column) -> Column:
    """JSON text in a model's answer: without fences, else the first braced part."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.when(bare.startswith("{"), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def leading_verbs(text: Column) -> Column:
    """The known verbs that the parts of an instruction begin with, in order; parts are joined by 'then'."""
    parts = F.split(F.lower(stripped(F.coalesce(text, F.lit("")))), r"\s+then\s+")
    return F.filter(F.transform(parts, lambda p: F.regexp_extract(stripped(p), f"^({VERBS.replace(' ', '|')})\\b", 1)), lambda v: v != "")


def words_of(many: Column, one: Column, lower: bool = False) -> Column:
    """A list field, or else its older single-valued form, as trimmed words without empty ones; never null."""
    held = F.coalesce(many, F.when(one.isNotNull() & (one != ""), F.array(one)), F.array().cast("array<string>"))
    clean = F.filter(F.transform(held, lambda w: stripped(w)), lambda w: w != "")
    return F.transform(clean, lambda w: F.lower(w)) if lower else clean


def primary_object(shared: Column, left: Column, nouns: Column) -> Column:
    """The shared object, else the left hand's first noun, else the first noun, in lower case; empty without any."""
    found = F.coalesce(F.nullif(stripped(shared), F.lit("")), F.get(left, 0), F.get(nouns, 0), F.lit(""))
    return F.lower(stripped(found))


def stored_fields(task: Column, instruction: Column, verbs: Column, nouns: Column, primary: Column, shared: Column) -> Column:
    """What a manifest row is stored under: instruction, verbs and primary object by their fallbacks; null without an instruction."""
    own = stripped(F.coalesce(F.nullif(task, F.lit("")), F.nullif(instruction, F.lit("")), F.lit("")))
    verb = F.when(F.size(F.coalesce(verbs, F.array().cast("array<string>"))) > 0, verbs).otherwise(leading_verbs(own))
    thing = F.coalesce(F.nullif(primary, F.lit("")), F.nullif(shared, F.lit("")), F.lower(stripped(F.get(nouns, 0))), F.lit(""))
    return F.when(own != "", F.struct(own.alias("instruction"), verb.alias("verbs"), thing.alias("primary_object")))


def combined_hand(text: Column, hand: str) -> Column:
    """One hand's part of a combined instruction, as it stands ('None' too), without full stops at its end; empty if missing."""
    end = r"(?=\s*right hand:|$)" if hand == "left" else r"$"
    return F.regexp_replace(stripped(F.regexp_extract(text, rf"(?is){hand} hand:\s*(.+?){end}", 1)), r"[.]+$", "")


def single_arm_fields(goal: Column, augmented: Column, hand: Column) -> Column:
    """instruction, task, left, right and augmented text of a task of one hand; only `left` rewrites the augmented text."""
    bare = F.regexp_replace(stripped(F.coalesce(goal, F.lit(""))), r"[.]+$", "")
    is_left, none = F.coalesce(hand == "left", F.lit(False)), F.lit("None")
    left, right = F.when(is_left, bare).otherwise(none), F.when(is_left, none).otherwise(bare)
    moved = F.coalesce(augmented, F.lit(""))
    for old, new in (("right hand", "left hand"), ("Right hand", "Left hand"), ("RIGHT hand", "LEFT hand"), ("RIGHT HAND", "LEFT HAND")):
        moved = F.replace(moved, F.lit(old), F.lit(new))
    moved = F.when(is_left, moved).otherwise(F.coalesce(augmented, F.lit("")))
    return F.struct(format_hands(left, right).alias("instruction"), bare.alias("task"), left.alias("left_hand"), right.alias("right_hand"), moved.alias("augmented"))


def without_openings(text: Column) -> Column:
    """A text without the fixed sentences it may open with, four rounds of them."""
    out = stripped(F.coalesce(text, F.lit("")))
    for _ in range(4):
        for opening in OPENINGS:
            out = stripped(F.regexp_replace(out, rf"^{opening}\s*", ""))
    return out


def is_slot_word(word: Column, preposition: Column) -> Column:
    """Prepositions: up to 30 characters of words; others: 3 to 24 letters and no stopword."""
    w = F.lower(stripped(word))
    phrase = w.rlike(r"^[a-z]+(?: [a-z]+)*$") & (F.length(w) <= 30)
    return F.coalesce(F.when(preposition, phrase).otherwise(w.rlike(r"^[a-z]{3,24}$") & ~w.isin(STOPWORDS.split())), F.lit(False))


def is_likely_noun(word: Column) -> Column:
    """Does it end as nouns do, with at least three letters before the ending?"""
    return word.rlike(rf"(?s)^.{{3,}}(?:{NOUN_ENDINGS.replace(' ', '|')})$")


def noun_key(noun: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(F.coalesce(noun, F.lit("")))), r"[\s_]+", " ")


def object_key(noun: Column, adjective: Column) -> Column:
    return F.concat(F.lower(F.coalesce(noun, F.lit(""))), F.lit("|"), F.lower(F.coalesce(adjective, F.lit(""))))


def is_food(noun: Column, adjective: Column) -> Column:
    marked = F.lower(F.coalesce(adjective, F.lit(""))).rlike(alternatives(FOOD_MARKS))
    return F.lower(stripped(F.coalesce(noun, F.lit("")))).isin(FOODS.split()) | marked


def is_surface(noun: Column) -> Column:
    return F.lower(stripped(F.coalesce(noun, F.lit("")))).isin(SURFACES.split())


def is_active(hand: Column) -> Column:
    return ~F.lower(stripped(F.coalesce(hand, F.lit("")))).isin("none", "none.", "")


def hand_mode(left: Column, right: Column) -> Column:
    """bimanual, left or right by the hands that have something to do; right where neither has."""
    return F.when(is_active(left) & is_active(right), "bimanual").when(is_active(left), "left").otherwise("right")


def segment_texts(text: Column, minima: Column) -> Column:
    """The texts of an episode's segments: two for one minimum, else three, the last one 'return home'."""
    own = stripped(F.coalesce(text, F.lit("")))
    parts = F.split(own, " and ", 2)
    first = F.coalesce(F.nullif(stripped(F.get(parts, 0)), F.lit("")), own)
    second = F.coalesce(F.nullif(stripped(F.get(parts, 1)), F.lit("")), F.lit("lift it"))
    second = F.when(F.lower(second).startswith("lift "), "lift it").otherwise(second)
    home = F.lit("return home")
    return F.when(minima == 1, F.array(first, home)).otherwise(F.array(first, second, home))


def overlay(own: Column, other: Column, hand: Column) -> Column:
    """'Left: ... | Right: ...' of an episode's captions, of which `own` is its hand's; 'None.' for a missing one."""
    mine, its = F.coalesce(own, F.lit("None.")), F.coalesce(other, F.lit("None."))
    right = F.concat(F.lit("Left: "), its, F.lit(" | Right: "), mine)
    return F.when(hand == "right", right).otherwise(F.concat(F.lit("Left: "), mine, F.lit(" | Right: "), its))
