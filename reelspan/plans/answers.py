"""Queries over model answers. The given tables hold none, so a part's names are put into answers of every form they come in; the SQL
states what each form holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions import answers
from reelspan.plans.queries import query
from reelspan.sources.tables import spread, table


def told(spark, sf: str) -> DataFrame:
    """An answer a part, in one of eight forms by its key."""
    noun = F.element_at(F.split("p_name", " "), -1)
    first, second = F.concat(F.lit("Pick the "), "p_name", F.lit(" and place it on the tray")), F.concat(F.lit("Lift the "), "p_name")
    a = F.to_json(F.struct(first.alias("instruction"), F.array(noun, F.lit(" ")).alias("nouns"), F.lit("Pick").alias("verbs")))
    b = F.to_json(F.struct(second.alias("instr"), noun.alias("noun"), F.array(F.lit(" Lift ")).alias("verb")))
    array = F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))
    forms = [
        array,
        F.concat(F.lit("```json\n"), a, F.lit("\n```")),
        F.concat(F.lit("Sure, here they are:\n"), array, F.lit("\nAnything else?")),
        F.concat(F.lit("1. "), first, F.lit("\n 2) "), second, F.lit("\n3. no\n4. Sing a long song")),
        F.concat(F.lit('{"instr": "'), first, F.lit('",\n{"instr": "Sing a song"}')),
        F.lit("I can't see a table."),
        F.concat(F.lit('[7, {"instruction": ""}, "x", null, '), b, F.lit("]")),
        F.concat(F.lit("```\n["), b, F.lit(", "), a, F.lit(", "), b, F.lit("]\n```  ")),
    ]
    kind = F.col("p_partkey") % len(forms)
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(kind == i, form).otherwise(text)
    return spread(table(spark, sf, "part").select("p_partkey", "p_name"), 50_000, "p_partkey").select("p_partkey", text.alias("answer"))


@query("""WITH t AS (SELECT p_partkey, p_partkey % 8 AS form, string_split(p_name, ' ')[-1] AS noun, 'Pick the ' || p_name || ' and place it on the tray' AS a, 'Lift the ' || p_name AS b FROM part),
a AS (SELECT *, {'t': a, 'n': noun, 'v': 'pick'} AS x, {'t': b, 'n': noun, 'v': 'lift'} AS y, {'t': a, 'n': '', 'v': ''} AS l, {'t': b, 'n': '', 'v': ''} AS m FROM t),
f AS (SELECT p_partkey, CASE WHEN form IN (0, 2) THEN [x, y] WHEN form = 1 THEN [x] WHEN form = 3 THEN [l, m] WHEN form = 4 THEN [l] WHEN form = 6 THEN [y] WHEN form = 7 THEN [y, x] ELSE [] END AS items FROM a)
SELECT p_partkey, (i - 1)::INT AS place, items[i].t AS instruction, items[i].n AS nouns, items[i].v AS verbs FROM f, unnest(range(1, len(items) + 1)) r(i)""")
def answered_instructions(spark, sf):
    """A row an instruction, two at most of an answer."""
    found, _ = answers.parsed(told(spark, sf), "answer", 2)
    return found.select("p_partkey", "place", "instruction", F.array_join("nouns", ",").alias("nouns"), F.array_join("verbs", ",").alias("verbs"))


@query("SELECT p_partkey, 'I can''t see a table.' AS answer FROM part WHERE p_partkey % 8 = 5")
def answers_without_instructions(spark, sf):
    return answers.parsed(told(spark, sf), "answer", 2)[1]


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(split_part(p_name, ' ', 1)) || ',big' WHEN 1 THEN lower(split_part(p_name, ' ', 2)) ELSE '' END AS words FROM part""")
def proposed_words(spark, sf):
    """Words that answers propose after their thoughts; broken ones and ones of another form propose none."""
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('<think>maybe {"words": ["no"]}\n</think>\n```json\n{"words": [" '), F.upper(first), F.lit(' ", "", "BIG"]}\n```')))
        .when(kind == 1, F.concat(F.lit('Here: {"words": ["'), second, F.lit('"], "kind": {"a": 1}} done')))
        .when(kind == 2, F.concat(F.lit('{"words": ["'), second, F.lit('"')))
        .otherwise(F.lit('{"terms": ["x"]}'))
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(answers.proposed_words(text), ",").alias("words"))


@query("""SELECT p_partkey, 'hold the ' || p_name AS left_hand, 'turn its lid' AS right_hand, CASE p_partkey % 5 WHEN 1 THEN 'left_then_right' ELSE 'simultaneous' END AS kind FROM part WHERE p_partkey % 5 IN (0, 1, 4)""")
def two_handed_answers(spark, sf):
    """Tasks split between hands; without a part or of an unknown kind they aren't taken."""
    kind = F.col("p_partkey") % 5
    order = F.when(kind == 0, " Simultaneous").when(kind == 1, "left_then_right").when(kind == 2, "in turn").otherwise("simultaneous")
    right = F.when(kind == 3, " ").otherwise("turn its lid")
    body = F.to_json(F.struct(F.concat(F.lit("hold the "), "p_name").alias("left_instruction"), right.alias("right_instruction"), order.alias("coordination_type")))
    text = F.when(kind == 4, F.concat(F.lit("["), body, F.lit("]"), F.lit(" {"))).when(kind == 1, F.concat(F.lit("So: "), body, F.lit("!"))).otherwise(body)
    found = table(spark, sf, "part").select("p_partkey", answers.two_hands(text).alias("h")).filter("h IS NOT NULL")
    return found.select("p_partkey", F.col("h.left").alias("left_hand"), F.col("h.right").alias("right_hand"), F.col("h.kind").alias("kind"))
