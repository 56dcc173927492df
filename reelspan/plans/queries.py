"""Queries over the given tables, each beside the same in DuckDB SQL.

Adapters: an episode is a user of `events`, its frames the events by (ts, event_id), the signal is
`value`; slot words are the "adjective noun" names of `part`; instructions are built from them or
are the documents; captions are conversation turns; a mixture is documents by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.functions import geometry, text
from reelspan.operators import corpus, episodes, sampling, vectors
from reelspan.sources.tables import spread, table
from reelspan.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def words(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.vocabulary(table(spark, sf, "part"), "p_name", ["adjective", "noun"])


WORDS = """words AS (
  SELECT word_type, word, count(*) AS frequency FROM (
    SELECT 'adjective' AS word_type, split_part(p_name, ' ', 1) AS word FROM part
    UNION ALL SELECT 'noun', split_part(p_name, ' ', 2) FROM part) WHERE word <> '' GROUP BY ALL)"""


def frames(spark: SparkSession, sf: str, each: int = 0) -> DataFrame:
    """Events as frames of their users; `each`: how many a task holds, where they become wide rows."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    events = spread(events, each, "user_id") if each else events
    return episodes.frames_of(events, "user_id", ["ts", "event_id"], F.col("value"))


FRAMES = """frames AS (
  SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         value AS signal, ts, event_id, event_type FROM events)"""


@query(f"""WITH {WORDS}
SELECT word_type, count(*) AS words, round(avg(frequency), 6) AS mean_frequency, max(frequency) AS max_frequency,
       round(CASE WHEN avg(frequency) > 0 THEN stddev_pop(frequency) / avg(frequency) ELSE 0 END, 6) AS cv
FROM words GROUP BY word_type""")
def diversity_report(spark, sf):
    return corpus.balance(words(spark, sf))


@query("""WITH long AS (
  SELECT 'o_orderpriority' AS dimension, o_orderpriority AS label FROM orders
  UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
  UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders),
n AS (SELECT dimension, label, count(*) AS n FROM long WHERE label IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, label) AS place FROM n) WHERE place <= 10""")
def top_labels(spark, sf):
    return corpus.label_counts(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"], 10)


@query("""SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS level, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus), ())""")
def diversity_grouping_sets(spark, sf):
    cube = table(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus")
    return cube.agg(F.grouping_id().alias("level"), F.count("*").alias("n")).select("o_orderpriority", "o_orderstatus", "level", "n")


@query(f"""WITH {WORDS}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_type ORDER BY frequency, word) AS place FROM words) WHERE place <= 5""")
def lowest_frequency_words(spark, sf):
    return corpus.lowest(words(spark, sf), 5)


@query(f"WITH {WORDS} SELECT word_type, word, frequency FROM words WHERE frequency < (SELECT avg(frequency) FROM words)")
def low_frequency_words(spark, sf):
    w = words(spark, sf)
    return w.crossJoin(F.broadcast(w.agg(F.avg("frequency").alias("_mean")))).filter("frequency < _mean").drop("_mean")  # one row


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value AS percentile_value FROM r WHERE i = least(floor(n * 0.9), n - 1)""")
def frequency_percentile(spark, sf):
    return corpus.percentile(table(spark, sf, "events"), "event_type", "value", 0.9)


@query(r"""SELECT doc_id, copies FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY k) AS copies
  FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM documents)) WHERE r = 1""")
def instruction_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(text.normalise(F.col("text")), 256).alias("_h"))
    return corpus.first_of_each(docs, F.col("_h"), "doc_id").select("doc_id", "copies")


FORMS = ["pick up the {}", "Push the {}", "push the {} to the left", "place the {}", "Place the {} on the tray", "pick-then-place the {} on the tray", "hand-lift the {}", "lift-up the {} ", "move the {} near the box", "grab the {}"]
INSTRUCTION = f"""made AS (SELECT p_partkey, CASE p_partkey % {len(FORMS)} {" ".join(f"WHEN {i} THEN '" + x.replace("{}", "' || p_name || '") + "'" for i, x in enumerate(FORMS))} END AS instruction FROM part)"""


def instructions(spark, sf):
    made = F.lit(None).cast("string")
    for i, form in enumerate(FORMS):
        start, end = form.split("{}")
        made = F.when(F.col("p_partkey") % len(FORMS) == i, F.concat(F.lit(start), F.col("p_name"), F.lit(end))).otherwise(made)
    return table(spark, sf, "part").select("p_partkey", made.alias("instruction"))


VALID = rf"""length(x) >= 8 AND NOT regexp_matches(x, '\b(pick|grasp)-then-place\b', 'i') AND regexp_matches(x, '^{text.alternatives(text.VERBS)}\b', 'i')
  AND (NOT regexp_matches(x, '\bplace\b', 'i') OR regexp_matches(x, '{text.PLACED}', 'i'))
  AND (NOT regexp_matches(x, '\b(move|push|pull|slide)\b', 'i') OR regexp_matches(x, '{text.DIRECTED}', 'i'))"""


@query(f"WITH {INSTRUCTION}, t AS (SELECT *, trim(instruction) AS x FROM made) SELECT p_partkey, instruction FROM t WHERE {VALID}")
def valid_instructions(spark, sf):
    return instructions(spark, sf).filter(text.is_valid_instruction(F.col("instruction")))


@query(rf"""WITH {INSTRUCTION}, t AS (SELECT *, trim(instruction) AS x, trim(regexp_replace(lower(instruction), '\s+', ' ', 'g')) AS k FROM made)
SELECT p_partkey, copies FROM (SELECT p_partkey, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY k) AS copies FROM t WHERE {VALID}) WHERE r = 1""")
def valid_distinct_instructions(spark, sf):
    valid = instructions(spark, sf).filter(text.is_valid_instruction(F.col("instruction")))
    return corpus.first_of_each(valid, text.normalise(F.col("instruction")), "p_partkey").select("p_partkey", "copies")


@query(r"""SELECT doc_id, regexp_matches(lower(text), '\b""" + text.alternatives(text.COLOURS) + r"""\b') AS has_colour FROM documents""")
def colour_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.has_colour(F.col("text")).alias("has_colour"))


ANSWERED = r"""answered AS (SELECT u.conv_id, u.turn, 'Left hand: ' || coalesce(nullif(trim(regexp_replace(trim(u.text), '[.]+$', '')), ''), 'None')
  || '. Right hand: ' || coalesce(nullif(trim(regexp_replace(trim(a.text), '[.]+$', '')), ''), 'None') || '.' AS instruction
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


def answered(spark, sf):
    """Every user turn with its answer, as the two hands; whole texts."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("l"))
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    return asked.join(answers, ["conv_id", "turn"], "left").select("conv_id", "turn", text.format_hands(F.col("l"), F.col("r")).alias("instruction"))


SWAPPED = ["upright", chr(1), "leftover", chr(2), "Left", chr(3), "Right", "Left", chr(3), "Right", "left", chr(3), "right", "left", chr(3), "right"]


def swapped_sql(x: str) -> str:
    for old, new in zip(SWAPPED[::2], SWAPPED[1::2], strict=True):
        x = f"replace({x}, '{old}', '{new}')"
    return x


@query(rf"""WITH {ANSWERED}, s AS (SELECT conv_id, turn, {swapped_sql('instruction')} AS x FROM answered),
p AS (SELECT *, instr(x, 'Left hand:') AS l, instr(x, 'Right hand:') AS r FROM s),
c AS (SELECT conv_id, turn, regexp_replace(CASE WHEN l < r THEN substr(x, l, r - l) ELSE substr(x, l) END, '^\s+|\s+$', '', 'g') || ' ' ||
  regexp_replace(CASE WHEN r < l THEN substr(x, r, l - r) ELSE substr(x, r) END, '^\s+|\s+$', '', 'g') AS y FROM p)
SELECT conv_id, turn, replace(replace(y, chr(1), 'upright'), chr(2), 'leftover') AS mirrored FROM c""")
def mirrored_hand_turns(spark, sf):
    return answered(spark, sf).select("conv_id", "turn", text.swap_sides(F.col("instruction")).alias("mirrored"))


@query(f"WITH {ANSWERED} SELECT conv_id, turn, instruction FROM answered")
def format_hand_instruction(spark, sf):
    return answered(spark, sf)


@query(rf"""WITH {ANSWERED}, p AS (SELECT conv_id, turn, trim(regexp_extract(instruction, '(?is)left hand:\s*(.*?)\.?\s*(?:right hand:|$)', 1)) AS a,
  trim(regexp_extract(instruction, '(?is)right hand:\s*(.*?)\.?\s*$', 1)) AS b FROM answered)
SELECT conv_id, turn, CASE WHEN a <> '' AND lower(a) <> 'none' THEN a END AS left_hand, CASE WHEN b <> '' AND lower(b) <> 'none' THEN b END AS right_hand FROM p""")
def parse_hand_instruction(spark, sf):
    return answered(spark, sf).select("conv_id", "turn", text.parse_hand(F.col("instruction"), "left").alias("left_hand"), text.parse_hand(F.col("instruction"), "right").alias("right_hand"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unprocessed_anti(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(done, "o_orderkey", "left_anti")


CAPTIONS = """captions AS (SELECT o_custkey AS episode, o_orderkey AS clip_idx, o_orderkey % 40 AS start_frame, o_orderkey % 40 + o_orderkey % 13 AS end_frame FROM orders)"""


def _captions(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("episode"), k.alias("clip_idx"), (k % 40).alias("start_frame"), (k % 40 + k % 13).alias("end_frame"))


@query(f"WITH {FRAMES}, {CAPTIONS} SELECT episode, frame_idx, clip_idx FROM frames JOIN captions USING (episode) WHERE frame_idx >= start_frame AND frame_idx < end_frame")
def caption_interval_join(spark, sf):
    return episodes.captions_at(frames(spark, sf), _captions(spark, sf)).select("episode", "frame_idx", "clip_idx")


@query(f"WITH {FRAMES}, {CAPTIONS} SELECT episode, frame_idx, clip_idx FROM frames JOIN captions USING (episode) WHERE frame_idx BETWEEN start_frame AND end_frame")
def caption_interval_join_closed(spark, sf):
    return episodes.captions_at(frames(spark, sf), _captions(spark, sf), closed=True).select("episode", "frame_idx", "clip_idx")


@query(f"WITH {FRAMES} SELECT episode, frame_idx, CAST(frame_idx > 10 + episode % 7 AS INT) + CAST(frame_idx > 30 + episode % 11 AS INT) AS segment FROM frames")
def segment_lookup(spark, sf):
    own = frames(spark, sf)
    points = own.select("episode").distinct().withColumn("points", F.array(10 + F.col("episode") % 7, 30 + F.col("episode") % 11))
    return episodes.segment_of(own, points).select("episode", "frame_idx", "segment")


@query("""SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS c_name, CASE WHEN a.c_custkey IS NOT NULL THEN 'key' WHEN b.c_custkey IS NOT NULL THEN 'fallback' ELSE 'none' END AS match_kind
FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey * 2 LEFT JOIN customer b ON b.c_custkey = o_custkey""")
def fallback_key_join(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    a, b = customers.toDF("_ka", "_a"), customers.toDF("_kb", "_b")
    joined = table(spark, sf, "orders").join(a, F.col("_ka") == F.col("o_custkey") * 2, "left").join(b, F.col("_kb") == F.col("o_custkey"), "left")
    kind = F.when(F.col("_ka").isNotNull(), "key").when(F.col("_kb").isNotNull(), "fallback").otherwise("none")
    return joined.select("o_orderkey", F.coalesce("_a", "_b").alias("c_name"), kind.alias("match_kind"))


@query("""WITH cat AS (SELECT split_part(p_name, ' ', 2) AS noun, split_part(p_name, ' ', 1) AS adjective, p_brand, min(p_partkey) AS k FROM part GROUP BY ALL),
refs AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS noun, split_part(p_name, ' ', 1) AS adjective, 'Brand#' || (p_partkey % 25 + 1) AS p_brand FROM part)
SELECT p_partkey, k AS resolved, quality FROM (
  SELECT r.p_partkey, c.k, CASE WHEN r.adjective = c.adjective AND r.p_brand = c.p_brand THEN 0 WHEN r.adjective = c.adjective THEN 1 ELSE 2 END AS quality,
    row_number() OVER (PARTITION BY r.p_partkey ORDER BY quality, c.k) AS place
  FROM refs r JOIN cat c USING (noun)) WHERE place = 1""")
def catalogue_resolution(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("adjective"), "p_brand")
    # by each form of the key its least entry: the candidates of a reference are three rows, not the noun's
    full = part.groupBy("noun", "adjective", "p_brand").agg(F.min("p_partkey").alias("k0"))
    half = part.groupBy("noun", "adjective").agg(F.min("p_partkey").alias("k1"))
    noun = part.groupBy("noun").agg(F.min("p_partkey").alias("k2"))
    refs = part.withColumn("p_brand", F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string")))
    found = refs.join(full, ["noun", "adjective", "p_brand"], "left").join(half, ["noun", "adjective"], "left").join(noun, "noun")
    quality = F.when(F.col("k0").isNotNull(), 0).when(F.col("k1").isNotNull(), 1).otherwise(2)
    return found.select("p_partkey", F.coalesce("k0", "k1", "k2").alias("resolved"), quality.alias("quality"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 900 AS x, l_suppkey * 7 % 900 AS y, 20 + l_quantity AS w, 20 + l_quantity AS h FROM lineitem)
SELECT DISTINCT a.l_orderkey, a.l_linenumber, a.l_partkey FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE a.l_orderkey = b.l_orderkey
  AND (a.l_linenumber, a.l_partkey) <> (b.l_linenumber, b.l_partkey) AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h)""")
def rect_overlap_semi(spark, sf):
    side = 20 + F.col("l_quantity")
    box = F.struct((F.col("l_partkey") % 900).alias("x"), (F.col("l_suppkey") * 7 % 900).alias("y"), side.alias("w"), side.alias("h"))
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box.alias("a"))
    b = a.toDF("_o", "_n", "_p", "b")
    other = (F.col("l_linenumber") != F.col("_n")) | (F.col("l_partkey") != F.col("_p"))
    return a.join(b, (F.col("l_orderkey") == F.col("_o")) & other & geometry.overlaps("a", "b"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey").distinct()


@query("""SELECT l_orderkey, l_linenumber, l_partkey, px, round_even(least(greatest(round_even(px * 1000.0 / 640, 0), 0), 1000), 0)::INT AS back FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, round_even((l_partkey % 1001) * 640 / 1000.0, 0)::INT AS px FROM lineitem)""")
def bbox_grid_roundtrip(spark, sf):
    px = geometry.to_pixels(F.col("l_partkey") % 1001, F.lit(640))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", px.alias("px"), geometry.to_grid(px, F.lit(640)).alias("back"))


@query(f"WITH {FRAMES} SELECT dense_rank() OVER (ORDER BY episode) - 1 AS episode_idx, episode, frame_idx FROM frames")
def episode_frame_index(spark, sf):
    return episodes.frame_index(table(spark, sf, "events").select(F.col("user_id").alias("episode")))


@query("""WITH n AS (SELECT user_id AS episode, count(*) AS n FROM events GROUP BY 1)
SELECT episode, i AS sample_idx, CASE WHEN n <= 16 THEN i WHEN i = 15 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 15))::BIGINT END AS frame_idx
FROM n, range(16) r(i) WHERE i < least(n, 16)""")
def uniform_sample(spark, sf):
    return episodes.uniform_picks(table(spark, sf, "events").select(F.col("user_id").alias("episode")), 16)


@query(f"WITH {FRAMES} SELECT episode, frame_idx, event_id FROM frames WHERE frame_idx % 8 = 3")
def every_nth_frame(spark, sf):
    return frames(spark, sf).filter("frame_idx % 8 = 3").select("episode", "frame_idx", "event_id")


SPEED = f"""{FRAMES}, moved AS (SELECT *, coalesce(abs(signal - lag(signal) OVER w), 0) AS speed FROM frames WINDOW w AS (PARTITION BY episode ORDER BY frame_idx)),
smoothed AS (SELECT *, sum(speed) OVER (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM moved)"""


@query(f"WITH {SPEED} SELECT episode, frame_idx, round(speed, 6) AS speed, round(smooth, 6) AS smooth FROM smoothed")
def speed_and_smooth(spark, sf):
    return episodes.speeds(frames(spark, sf)).select("episode", "frame_idx", F.round("speed", 6).alias("speed"), F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {FRAMES}, s AS (SELECT *, event_type IN ('view', 'signup') AS l, event_type IN ('click', 'purchase') AS r FROM frames),
steps AS (SELECT episode, abs(signal - lag(signal) OVER (PARTITION BY episode ORDER BY frame_idx)) AS d, true AS l FROM s WHERE l
  UNION ALL SELECT episode, abs(signal - lag(signal) OVER (PARTITION BY episode ORDER BY frame_idx)), false FROM s WHERE r),
paths AS (SELECT episode, coalesce(sum(d) FILTER (l), 0) AS lp, coalesce(sum(d) FILTER (NOT l), 0) AS rp FROM steps GROUP BY episode),
n AS (SELECT episode, count(*) AS frames, count(*) FILTER (l) AS left_frames, count(*) FILTER (r) AS right_frames FROM s GROUP BY episode)
SELECT episode, frames, left_frames, right_frames, round(greatest(coalesce(lp, 0), coalesce(rp, 0)) / greatest(frames - 1, 1), 6) AS avg_speed,
  CASE WHEN left_frames > right_frames THEN 'left' WHEN right_frames > left_frames THEN 'right' WHEN left_frames > 0 THEN 'both' ELSE 'none' END AS anno_type
FROM n LEFT JOIN paths USING (episode)""")
def episode_summary(spark, sf):
    sides = {"left": F.col("event_type").isin("view", "signup"), "right": F.col("event_type").isin("click", "purchase")}
    return episodes.hand_summary(frames(spark, sf), sides).withColumn("avg_speed", F.round("avg_speed", 6))


STEPS = f"""{FRAMES}, k AS (SELECT *, event_type <> 'error' AS kept FROM frames),
steps AS (SELECT *, kept AND coalesce(lead(kept) OVER w, false) AS valid, lead(signal) OVER w - signal AS d FROM k WINDOW w AS (PARTITION BY episode ORDER BY frame_idx))"""


@query(f"WITH {STEPS} SELECT episode, frame_idx, valid, round(CASE WHEN valid THEN d ELSE 0 END, 6) AS delta FROM steps")
def step_actions(spark, sf):
    out = episodes.step_actions(frames(spark, sf), F.col("event_type") != "error")
    return out.select("episode", "frame_idx", "valid", F.round("delta", 6).alias("delta"))


@query(f"""WITH {STEPS} SELECT episode, frame_idx, round(1 + coalesce(sum(CASE WHEN valid THEN d ELSE 0 END)
  OVER (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS position FROM steps""")
def trajectory_rebuild(spark, sf):
    out = episodes.rebuilt(episodes.step_actions(frames(spark, sf), F.col("event_type") != "error"), F.lit(1.0))
    return out.select("episode", "frame_idx", F.round("position", 4).alias("position"))


@query(f"""WITH {FRAMES}, c AS (SELECT episode, frame_idx, signal, list(signal) OVER (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS l FROM frames)
SELECT episode, frame_idx, array_to_string(list_transform(range(1, 5), lambda i: printf('%.2f', coalesce(l[i], l[-1], signal))), ',') AS chunk FROM c""")
def lookahead_chunk(spark, sf):
    out = episodes.lookahead(frames(spark, sf), 4)
    return out.select("episode", "frame_idx", F.array_join(F.transform("chunk", lambda x: F.format_string("%.2f", x)), ",").alias("chunk"))


@query(f"""WITH {FRAMES}, i AS (SELECT episode, frame_idx, frame_idx - row_number() OVER (PARTITION BY episode ORDER BY frame_idx) AS g FROM frames WHERE event_type <> 'error')
SELECT episode, min(frame_idx) AS start_frame, max(frame_idx) + 1 AS end_frame, count(*) AS frames FROM i GROUP BY episode, g""")
def mask_runs(spark, sf):
    return episodes.runs(frames(spark, sf), F.col("event_type") != "error")


@query(f"""WITH {FRAMES}, k AS (SELECT *, event_type <> 'error' AS known FROM frames),
e AS (SELECT episode, frame_idx, signal, known,
  last_value(CASE WHEN known THEN frame_idx END IGNORE NULLS) OVER p AS a, last_value(CASE WHEN known THEN signal END IGNORE NULLS) OVER p AS x,
  first_value(CASE WHEN known THEN frame_idx END IGNORE NULLS) OVER q AS b, first_value(CASE WHEN known THEN signal END IGNORE NULLS) OVER q AS y FROM k
  WINDOW p AS (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         q AS (PARTITION BY episode ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT episode, frame_idx, round(CASE WHEN known THEN signal ELSE x + (y - x) * ((frame_idx - a) / nullif(b - a, 0)) END, 6) AS filled FROM e""")
def linear_interpolation(spark, sf):
    return episodes.interpolated(frames(spark, sf), F.col("event_type") != "error").select("episode", "frame_idx", F.round("filled", 6).alias("filled"))


SIGNAL_SCALE = 2_000.0


@query()
def split_points(spark, sf):
    """Slow minima of smoothed speed: order-dependent, so tested against brute force.

    `value` moves some thousands of times as much in a step as a wrist does in metres, so both
    limits of the operator are scaled by that.
    """
    scaled = frames(spark, sf).withColumn("signal", F.col("signal") / SIGNAL_SCALE)
    return episodes.split_points(episodes.speeds(scaled))


STATS = """stats AS (SELECT label, i - 1 AS dim, avg(x) AS mean, stddev_pop(x) AS std, count(x) AS num_rows
  FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
    WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0) GROUP BY label, i)"""


def _stats(spark, sf):
    """By label and dimension over every vector whose values are all finite."""
    rows = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.masked_statistics(rows, "embedding", finite, ["label"])


@query(f"WITH {STATS} SELECT label, dim, round(mean, 6) AS mean, round(std, 6) AS std, num_rows FROM stats")
def masked_statistics(spark, sf):
    return _stats(spark, sf).select("label", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "num_rows")


@query(f"WITH {STATS} SELECT dim, round(sum(num_rows * mean) / sum(num_rows), 6) AS mean, round(sum(num_rows * std) / sum(num_rows), 6) AS std FROM stats GROUP BY dim")
def merge_statistics(spark, sf):
    return vectors.merged_statistics(_stats(spark, sf), F.col("num_rows")).select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""SELECT i - 1 AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
FROM embeddings WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0) GROUP BY i""")
def pooled_statistics(spark, sf):
    return vectors.merged_statistics(_stats(spark, sf), F.col("num_rows"), "pooled").select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {STATS}, e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT vec_id, round(sum((x - mean) / (std + 1e-7)), 4) AS total, round(max((x - mean) / (std + 1e-7)), 4) AS largest FROM e JOIN stats USING (label, dim) GROUP BY vec_id""")
def normalise_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    joined = rows.join(F.broadcast(vectors.as_arrays(_stats(spark, sf), ["label"])), "label")  # a row a label
    z = joined.select("vec_id", geometry.normalised(F.col("x"), F.col("means"), F.col("stds")).alias("z"))
    return z.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round(F.array_max("z"), 4).alias("largest"))


@query("""SELECT vec_id, 96 AS width, round(list_sum([CASE WHEN (i + vec_id) % 4 <> 0 THEN embedding[i + 1]::DOUBLE ELSE 0 END for i in range(64)]), 6) AS total FROM embeddings""")
def pad_and_mask(spark, sf):
    x = F.col("embedding").cast("array<double>")
    mask = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: (i + F.col("vec_id")) % 4 != 0)
    out = table(spark, sf, "embeddings").select("vec_id", geometry.padded(x, mask, 96).alias("p"))
    return out.select("vec_id", F.size("p").alias("width"), F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("""WITH p AS (SELECT a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
d AS (SELECT unnest(x)::DOUBLE AS u, unnest(y)::DOUBLE AS v, generate_subscripts(x, 1) - 1 AS dim FROM p)
SELECT CASE WHEN dim < 16 THEN 'translation' WHEN dim < 32 THEN 'rotation' ELSE 'pose' END AS name, round(avg((u - v) * (u - v)), 6) AS mse, count(*) AS terms FROM d GROUP BY 1""")
def masked_mse_by_slice(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    slices = spark.createDataFrame([("translation", 0, 16), ("rotation", 16, 32), ("pose", 32, 64)], "name string, start int, stop int")
    return vectors.slice_errors(pairs, "x", "y", slices).select("name", F.round("mse", 6).alias("mse"), "terms")


@query("SELECT source, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM documents GROUP BY source")
def mixture_ratio(spark, sf):
    return sampling.mixture(table(spark, sf, "documents"), "source").withColumn("ratio", F.round("ratio", 6))


@query("""SELECT o_orderkey, r AS rollout, o_orderkey + r * 1000 AS seed, o_orderkey || ':' || printf('%02d', r) AS rollout_id FROM orders, range(3) t(r)""")
def rollout_expansion(spark, sf):
    return sampling.rollouts(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 3, 1000)


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS t FROM orders)
SELECT o_orderkey, (CASE WHEN i < (t % 7) * (t // 7 + 1) THEN i // (t // 7 + 1) ELSE t % 7 + (i - (t % 7) * (t // 7 + 1)) // (t // 7) END)::BIGINT AS chunk FROM n""")
def even_chunks(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    low, high, total = orders.agg(F.min("o_orderkey"), F.max("o_orderkey"), F.count("*")).first()
    bucket = F.floor((F.col("o_orderkey") - F.lit(low)) * sampling.BUCKETS / F.lit(max(high - low + 1, 1)))
    numbered = sampling.ordinal(orders, bucket, [F.col("o_orderkey")], "_i")
    return sampling.even_chunks(numbered, "_i", total, 7).select("o_orderkey", "chunk")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS v FROM part)
SELECT * FROM (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM c WHERE v <= 2) WHERE place <= 5""")
def top_k_diverse(spark, sf):
    out = corpus.greedy_top(table(spark, sf, "part"), "p_brand", "p_type", "p_retailprice", "p_partkey", 2, 5)
    return out.select("p_brand", "p_type", "p_partkey", "place")


@query()
def weighted_sample(spark, sf):
    """Rarer words more often, without replacement; random by seed, so tested by its properties."""
    return corpus.weighted_sample(words(spark, sf), "word_type", "word", "frequency", 4, 1.0, 11)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY event_type")
def timing_stats(spark, sf):
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round((F.max(ts) - F.min(ts)) / 1e6, 3).alias("seconds"))


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS smoothed,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 3) AS step_seconds FROM events""")
def rolling_metrics(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    step = (micros - F.lag(micros).over(w)) / 1e6
    return table(spark, sf, "events").select("user_id", "event_id", F.round(F.avg("value").over(w.rowsBetween(-9, 0)), 6).alias("smoothed"), F.round(step, 3).alias("step_seconds"))


@query("""SELECT DISTINCT o_orderstatus || '_' || o_orderkey AS task_id, o_orderstatus AS worker, o_totalprice FROM orders""")
def merge_manifests(spark, sf):
    parts = [table(spark, sf, "orders").filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    merged = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return merged.select(F.concat_ws("_", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("task_id"), F.col("o_orderstatus").alias("worker"), "o_totalprice").distinct()


@query(f"""WITH {FRAMES}, n AS (SELECT episode, count(*) AS n, min(frame_idx) AS lo, max(frame_idx) AS hi, count(DISTINCT frame_idx) AS d FROM frames GROUP BY episode)
SELECT count(*) AS episodes, sum(n)::BIGINT AS frames, count(*) FILTER (lo <> 0 OR hi <> n - 1 OR d <> n) AS broken FROM n""")
def verify_frame_index(spark, sf):
    own = frames(spark, sf).groupBy("episode").agg(F.count("*").alias("n"), F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"), F.countDistinct("frame_idx").alias("d"))
    return own.agg(F.count("*").alias("episodes"), F.sum("n").alias("frames"), F.count_if((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n"))).alias("broken"))


@query("""SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000""")
def missing_members(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey").subtract(table(spark, sf, "supplier").filter("s_acctbal > 9000").select("s_nationkey"))


@query("""SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def shared_members(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey").intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    out = jobs.updated(jobs.throughput(jobs.replay(spark, f"{sf}/events.parquet"), "1 hour"), ["window_start", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL (30 * k) MINUTE AS window_start, event_type, value FROM events, range(2) r(k))
SELECT window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM w GROUP BY ALL""")
def stream_sliding(spark, sf):
    out = jobs.updated(jobs.throughput(jobs.replay(spark, f"{sf}/events.parquet"), "1 hour", "30 minutes"), ["window_start", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '2 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf):
    out = jobs.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 hours")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    twice = jobs.replay(spark, f"{sf}/events.parquet")
    return jobs.drained(jobs.once(twice.unionByName(twice), "event_id").select("event_id", "user_id", "event_type"))


@query("""SELECT p.user_id, p.event_id AS produced_id, c.event_id AS consumed_id FROM events p JOIN events c ON p.user_id = c.user_id
AND p.event_type = 'view' AND c.event_type = 'purchase' AND c.ts > p.ts AND c.ts <= p.ts + INTERVAL '1 hour'""")
def stream_join(spark, sf):
    rows = jobs.replay(spark, f"{sf}/events.parquet")
    return jobs.drained(jobs.waits(rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'"), "user_id", "1 hour"))
