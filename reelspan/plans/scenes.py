"""Queries over placed scenes and assembled instructions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.operators import assembly, placement
from reelspan.plans.more import SEED, sql_draw
from reelspan.plans.queries import WORDS, query, words
from reelspan.sources.tables import table

LAYOUT = placement.Layout(seed=SEED, apart=0.45, jitter=0.08)


def desks(spark, sf: str) -> DataFrame:
    """A scene a part: one to four objects, and two hands that boxes must not meet."""
    x, y = F.col("p_partkey") * 37 % 400, F.col("p_partkey") * 53 % 200
    zones = F.array(*[F.struct(a.cast("int").alias("x0"), b.cast("int").alias("y0"), (a + w).cast("int").alias("x1"), (b + h).cast("int").alias("y1")) for a, b, w, h in ((x, y + 100, 150, 180), (x + 160, y + 60, 120, 220))])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("scene"), (1 + F.col("p_size") % 4).cast("int").alias("objects"), zones.alias("zones"))


def u(name: str, *keys: str) -> str:
    return f"({sql_draw(chr(39) + name + chr(39), *keys)} / 4294967296.0::DOUBLE)"


def span(low: str, high: str, shift: str, limits: tuple, highest: float, least: float, name: str) -> str:
    start = f"greatest({limits[0]}::DOUBLE, least({highest}::DOUBLE, {low} + {shift}))"
    return f"{start} AS {name}0, greatest({start} + {least}::DOUBLE, least({limits[1]}::DOUBLE, {high} + {shift})) AS {name}1"


def size(name: str, low: int, tops: list[int]) -> str:
    top = f"CASE WHEN attempt >= 16 THEN {tops[1]} ELSE {tops[0]} END"
    draws = {d: u(f"{name} {d}", "scene", "attempt", "object") for d in ("even", "end", "size")}
    end = f"CASE WHEN {draws['end']} < 0.5 THEN pow({draws['size']}, {LAYOUT.skew}::DOUBLE) ELSE 1 - pow(1 - {draws['size']}, {LAYOUT.skew}::DOUBLE) END"
    value = f"CASE WHEN {draws['even']} < 0.35 THEN {low} + floor({draws['size']} * ({top} - {low} + 1)) ELSE floor({low} + ({end}) * ({top} - {low})) END"
    return f"(ceil(greatest({value}, 16) / 16) * 16)::INT"


def centre(axis: str, side: str, image: int) -> str:
    a, b = f"greatest({axis}0 * {image}, {side} / 2)", f"least({axis}1 * {image}, {image} - {side} / 2)"
    at = f"CASE WHEN {a} > {b} THEN {side} / 2 + ({image} - {side} / 2 - {side} / 2) * {{u}} ELSE {a} + ({b} - {a}) * {{u}} END".format(u=u(f"centre {axis}", "scene", "attempt", "object", "t"))
    return f"greatest(0, least(trunc({at} - {side} / 2)::INT, {image} - {side}))"


KEYS = ("scene", "attempt")
OWN = (*KEYS, "object")
PLACED = f"""s AS (SELECT p_partkey AS scene, 1 + p_size % 4 AS objects, p_partkey * 37 % 400 AS zx, p_partkey * 53 % 200 AS zy FROM part),
a AS (SELECT *, (2 * {u("scene x", *KEYS)} - 1) * 0.08::DOUBLE AS jx, (2 * {u("scene y", *KEYS)} - 1) * 0.08::DOUBLE AS jy FROM s, range(32) r(attempt)),
b AS (SELECT * EXCLUDE (jx, jy), {span("0.1::DOUBLE", "0.9::DOUBLE", "jx", (0.03, 0.97), 0.94, 0.08, "bx")}, {span("0.2::DOUBLE", "0.8::DOUBLE", "jy", (0.04, 0.92), 0.86, 0.08, "by")} FROM a),
c AS (SELECT scene, objects, zx, zy, attempt, CASE WHEN attempt >= 24 THEN greatest(0.03::DOUBLE, bx0 - 0.08::DOUBLE) ELSE bx0 END AS cx0, CASE WHEN attempt >= 24 THEN least(0.97::DOUBLE, bx1 + 0.08::DOUBLE) ELSE bx1 END AS cx1,
  CASE WHEN attempt >= 8 THEN greatest(0.04::DOUBLE, by0 - 0.06::DOUBLE) ELSE by0 END AS cy0, CASE WHEN attempt >= 8 THEN least(0.92::DOUBLE, by1 + 0.06::DOUBLE) ELSE by1 END AS cy1 FROM b),
o AS (SELECT *, (cx1 - cx0) / objects AS step, cx0 + (object + 0.5::DOUBLE) * ((cx1 - cx0) / objects) AS middle FROM c, unnest(range(objects)) t(object)),
q AS (SELECT *, least(step * 0.2::DOUBLE, 0.08::DOUBLE) AS half, CASE WHEN objects > 1 THEN least({0.08 * 0.6}::DOUBLE, step * 0.15::DOUBLE) ELSE {0.08 * 0.6}::DOUBLE END AS own FROM o),
n AS (SELECT *, CASE WHEN objects > 1 THEN greatest(cx0, middle - half) ELSE cx0 END AS low, CASE WHEN objects > 1 THEN least(cx1, middle + half) ELSE cx1 END AS top,
  (2 * {u("object x", *OWN)} - 1) * own AS sx, (2 * {u("object y", *OWN)} - 1) * own AS sy FROM q),
z AS (SELECT scene, objects, zx, zy, attempt, object, {span("low", "top", "sx", (0.03, 0.97), 0.94, 0.06, "x")}, {span("cy0", "cy1", "sy", (0.04, 0.92), 0.86, 0.06, "y")},
  {size("width", 60, [160, 128])} AS w, {size("height", 60, [140, 105])} AS h FROM n),
k AS (SELECT scene, objects, zx, zy, attempt, object, t, w, h, {centre("x", "w", 640)} AS left_, {centre("y", "h", 480)} AS top_ FROM z, range(4) r(t)),
f AS (SELECT * FROM k WHERE NOT (left_ < zx + 150 AND zx < left_ + w AND top_ < zy + 280 AND zy + 100 < top_ + h) AND NOT (left_ < zx + 280 AND zx + 160 < left_ + w AND top_ < zy + 280 AND zy + 60 < top_ + h)),
l AS MATERIALIZED (SELECT scene, attempt, object, any_value(objects) AS objects, min_by({{'x0': left_, 'y0': top_, 'x1': left_ + w, 'y1': top_ + h}}, t) AS box FROM f GROUP BY scene, attempt, object),
whole AS (SELECT scene, attempt FROM l GROUP BY scene, attempt HAVING count(*) = any_value(objects)),
near AS (SELECT DISTINCT p.scene, p.attempt FROM l p JOIN l r ON p.scene = r.scene AND p.attempt = r.attempt AND p.object < r.object
  WHERE sqrt(pow((p.box.x0 + p.box.x1) / 2 - (r.box.x0 + r.box.x1) / 2, 2) + pow((p.box.y0 + p.box.y1) / 2 - (r.box.y0 + r.box.y1) / 2, 2)) < {LAYOUT.apart * 480}),
won AS (SELECT scene, min(attempt) AS attempt FROM whole ANTI JOIN near USING (scene, attempt) GROUP BY scene)"""


@query(f"""WITH {PLACED} SELECT s.scene, won.attempt::INT AS attempt, l.object::INT AS object, l.box.x0 AS x0, l.box.y0 AS y0, l.box.x1 AS x1, l.box.y1 AS y1
FROM s LEFT JOIN won USING (scene) LEFT JOIN l ON l.scene = s.scene AND l.attempt = won.attempt""")
def placed_objects(spark, sf):
    """The boxes of each scene's first standing attempt; a row of nulls for scenes without one."""
    out = placement.placed(desks(spark, sf), LAYOUT)
    boxes = out.select("scene", "attempt", F.explode_outer("boxes").alias("b"))
    return boxes.select("scene", "attempt", "b.object", "b.box.x0", "b.box.y0", "b.box.x1", "b.box.y1")


TEMPLATES = [
    (0, "place_on", "place the {d1} {n1} on the {n2}", [("d1", "quality"), ("n1", "object"), ("n2", "object")]),
    (1, "slide_beside", "slide the {n1} beside the {d2} {n2}", [("n1", "object"), ("d2", "quality"), ("n2", "object")]),
    (2, "lift", "lift the {d1} {n1}", [("d1", "quality"), ("n1", "object")]),
]
ROUNDS, SHARE, CAP_SHARE, SKIP = 2, 8, 6, 0.25


def slot_words(spark, sf: str) -> DataFrame:
    """Adjectives for both qualities and nouns for both objects, used as often as their frequency leaves over four."""
    slots = F.when(F.col("word_type") == "adjective", F.array(F.lit("d1"), F.lit("d2"))).otherwise(F.array(F.lit("n1"), F.lit("n2")))
    return words(spark, sf).select(F.explode(slots).alias("slot"), "word", (F.col("frequency") % 4).alias("used"))


def _assembly_sql() -> str:
    marks = ("d1", "d2", "n1", "n2")
    tables = [
        WORDS,
        "t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}', '{pattern}', [{', '.join(chr(39) + s + chr(39) for s, _ in slots)}])" for i, name, pattern, slots in TEMPLATES) + ") v(place, template_id, pattern, slots))",
        f"total AS (SELECT count(*) // {SHARE} AS wanted, greatest(count(*) // {SHARE} // {CAP_SHARE}, 1) AS cap FROM part)",
        "w0 AS (SELECT slot, word, frequency % 4 AS used FROM words, unnest(CASE WHEN word_type = 'adjective' THEN ['d1', 'd2'] ELSE ['n1', 'n2'] END) u(slot))",
        "k0 AS (SELECT DISTINCT 'lift the ' || lower(p_name) AS k FROM part WHERE p_size > 25)",
        "u0 AS (SELECT '' AS word, 0::BIGINT AS used WHERE false)", "need0 AS (SELECT wanted AS need, cap FROM total)",
    ]
    for r in range(ROUNDS):
        text = "c.pattern"
        for m in marks:
            text = f"replace({text}, '{{{m}}}', coalesce(max(CASE WHEN p.slot = '{m}' THEN p.word END), ''))"
        tables += [
            f"cum{r} AS (SELECT slot, word, 1000000 // (used + 1) AS w, sum(1000000 // (used + 1)) OVER (PARTITION BY slot ORDER BY ('0x' || substr(md5(word), 1, 2))::INT, word) AS upto, sum(1000000 // (used + 1)) OVER (PARTITION BY slot) AS total FROM w{r})",
            f"n{r} AS (SELECT {r} AS round, unnest(range(need * 3)) AS n FROM need{r})",
            f"d{r} AS (SELECT round, n, ({sql_draw(chr(39) + 'template' + chr(39), 'round', 'n')} * {len(TEMPLATES)}) >> 32 AS place FROM n{r})",
            f"c{r} AS (SELECT round, n, template_id, pattern, slots FROM d{r} JOIN t USING (place))",
            f"s{r} AS (SELECT round, n, unnest(slots) AS slot FROM c{r})",
            f"a{r} AS (SELECT *, slot LIKE 'd%' AND {sql_draw(chr(39) + 'skip' + chr(39), 'round', 'n', 'slot')} < {int(SKIP * (1 << 32))} AS skipped, {sql_draw('round', 'n', 'slot')} AS drawn FROM s{r})",
            f"p{r} AS (SELECT round, n, slot, word FROM a{r} JOIN cum{r} USING (slot) WHERE NOT skipped AND floor(drawn / 4294967296.0::DOUBLE * total) >= upto - w AND floor(drawn / 4294967296.0::DOUBLE * total) < upto)",
            f"f{r} AS (SELECT c.round, c.n, c.template_id, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS instruction, list(lower(p.word)) FILTER (p.slot LIKE 'n%') AS objects FROM c{r} c JOIN p{r} p USING (n) GROUP BY c.round, c.n, c.template_id, c.pattern)",
            f"g{r} AS (SELECT * FROM (SELECT *, lower(instruction) AS k, row_number() OVER (PARTITION BY lower(instruction) ORDER BY n) AS copy FROM f{r} WHERE len(objects) = len(list_distinct(objects))) WHERE copy = 1 AND k NOT IN (SELECT k FROM k{r}))",
            f"e{r} AS (SELECT n, word, row_number() OVER (PARTITION BY word ORDER BY n) AS place FROM (SELECT n, unnest(objects) AS word FROM g{r}))",
            f"o{r} AS (SELECT DISTINCT n FROM e{r} LEFT JOIN u{r} USING (word) WHERE place + coalesce(used, 0) > (SELECT cap FROM total))",
            f"x{r} AS MATERIALIZED (SELECT * FROM (SELECT g.*, row_number() OVER (ORDER BY n) AS pos FROM g{r} g WHERE n NOT IN (SELECT n FROM o{r})) WHERE pos <= (SELECT need FROM need{r}))",
            f"v{r} AS (SELECT slot, word, count(*) AS more FROM x{r} JOIN p{r} USING (n) GROUP BY slot, word)",
            f"w{r + 1} AS (SELECT slot, word, used + coalesce(more, 0) AS used FROM w{r} LEFT JOIN v{r} USING (slot, word))",
            f"k{r + 1} AS (SELECT k FROM k{r} UNION SELECT k FROM x{r})",
            f"u{r + 1} AS (SELECT word, sum(used)::BIGINT AS used FROM (SELECT * FROM u{r} UNION ALL SELECT unnest(objects), 1 FROM x{r}) GROUP BY word)",
            f"need{r + 1} AS (SELECT need - (SELECT count(*) FROM x{r}) AS need, cap FROM need{r})",
        ]
    return f"WITH {', '.join(tables)} {' UNION ALL '.join(f'SELECT round, n, template_id, instruction FROM x{r}' for r in range(ROUNDS))}"


@query(_assembly_sql())
def assembled_instructions(spark, sf):
    """Instructions from three templates: as many as an eighth of the parts, each noun in a sixth of them at most, in two rounds."""
    parts = table(spark, sf, "part")
    wanted = parts.count() // SHARE
    templates = spark.createDataFrame(TEMPLATES, "place long, template_id string, pattern string, slots array<struct<name:string,kind:string>>")
    known = parts.filter("p_size > 25").select(F.concat(F.lit("lift the "), "p_name").alias("instruction"))
    out = assembly.assembled(templates, slot_words(spark, sf), known, wanted, max(wanted // CAP_SHARE, 1), SEED, ROUNDS, SKIP)
    return out.select("round", "n", "template_id", "instruction")
