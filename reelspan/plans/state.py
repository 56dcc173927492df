"""Queries over corpus state, wording rules, lookups, interleaving and stream accounting, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.functions import text
from reelspan.operators import draws, lookup, sampling, snapshots
from reelspan.plans.more import SEED, sql_draw
from reelspan.plans.queries import ANSWERED, WORDS, answered, query, words
from reelspan.sources.tables import spread, table
from reelspan.streaming import jobs


def spoken(spark, sf, role: str) -> DataFrame:
    """Lower-case words of a role's turns with their frequency."""
    turns = table(spark, sf, "conversations").filter(F.col("role") == role)
    return turns.select(F.explode(F.split(F.lower("text"), r"[\s.,]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("frequency"))


SPOKEN = r"""spoken AS (SELECT role, word, count(*) AS frequency FROM (SELECT role, unnest(regexp_split_to_array(lower(text), '[\s.,]+')) AS word FROM conversations) WHERE word <> '' GROUP BY ALL)"""


@query(f"WITH {SPOKEN} SELECT word, sum(frequency)::BIGINT AS frequency FROM spoken WHERE role IN ('user', 'assistant') GROUP BY word")
def merged_word_counts(spark, sf):
    return snapshots.merged(spoken(spark, sf, "user"), spoken(spark, sf, "assistant"), ["word"], "frequency")


@query(f"""WITH {SPOKEN} SELECT word, CASE WHEN count(*) = 2 THEN 'both' WHEN min(role) = 'user' THEN 'old' ELSE 'new' END AS origin FROM spoken WHERE role IN ('user', 'assistant') GROUP BY word""")
def vocabulary_growth(spark, sf):
    return snapshots.vocabulary_growth(spoken(spark, sf, "user"), spoken(spark, sf, "assistant"), "word")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size > 48)")
def new_instructions(spark, sf):
    parts = table(spark, sf, "part")
    return snapshots.known(parts.select("p_partkey", "p_name"), parts.filter("p_size > 48"), "p_name", text.normalise, new=True)


CAPS = {"adjective": 60, "noun": 40}


def caps(spark) -> DataFrame:
    return spark.createDataFrame(list(CAPS.items()), "word_type string, cap long")


USE = f"""{WORDS}, use AS (SELECT word_type, count(*) AS words, min(frequency) AS least, max(frequency) AS most FROM words GROUP BY word_type),
caps AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in CAPS.items())}) v(word_type, cap)), slots AS (SELECT * FROM (VALUES ('adjective'), ('noun'), ('verb')) v(word_type))"""


@query(f"""WITH {USE} SELECT s.word_type, coalesce(words, 0) AS words, least, most, coalesce(most >= cap AND s.word_type <> 'verb', false) AS at_cap, coalesce(words, 0) < 10 - 1 AS short
FROM slots s LEFT JOIN use USING (word_type) LEFT JOIN caps USING (word_type)""")
def slot_usage(spark, sf):
    use = snapshots.usage(words(spark, sf), "word_type", "frequency")
    slots = spark.createDataFrame([("adjective",), ("noun",), ("verb",)], "word_type string")
    full = snapshots.at_cap(use, caps(spark), "word_type", ["verb"]).select("word_type", F.lit(True).alias("at_cap"))
    short = snapshots.short_of(slots, use, "word_type", 10, 1).select("word_type", F.lit(True).alias("short"))
    rows = slots.join(use, "word_type", "left").join(full, "word_type", "left").join(short, "word_type", "left")
    no = F.lit(False)
    return rows.select("word_type", F.coalesce("words", F.lit(0)).alias("words"), "least", "most", F.coalesce("at_cap", no).alias("at_cap"), F.coalesce("short", no).alias("short"))


@query(f"""WITH {USE} SELECT coalesce(bool_or(coalesce(most >= cap, false)) OR bool_and(least >= 5), false) AS expand FROM use LEFT JOIN caps USING (word_type)""")
def expansion_trigger(spark, sf):
    use = snapshots.usage(words(spark, sf), "word_type", "frequency")
    return snapshots.should_expand(use.select("word_type"), use, caps(spark), "word_type", 5, ["verb"])


@query(f"""WITH {WORDS}, s AS (SELECT 'noun' AS word_type, lower(p_type) AS word, min(p_partkey) AS place FROM part GROUP BY ALL),
r AS (SELECT word_type, word, row_number() OVER (ORDER BY place, word) AS r FROM s WHERE word NOT IN (SELECT word FROM words WHERE word_type = 'noun'))
SELECT word_type, word, frequency FROM words UNION ALL SELECT word_type, word, 0 FROM r WHERE r <= 2""")
def seeded_words(spark, sf):
    """Part types as seed nouns, until there are two nouns more than the snapshot has."""
    own = words(spark, sf)
    seeds = table(spark, sf, "part").select(F.lit("noun").alias("word_type"), F.lower("p_type").alias("word"), F.col("p_partkey").alias("place"))
    least = own.filter("word_type = 'noun'").count() + 2
    return snapshots.seeded(own, seeds, "word_type", "word", "frequency", least)


@query("SELECT event_type, count(*) AS frequency FROM events GROUP BY event_type")
def stream_counters(spark, sf):
    """Counters of a stream carried from batch to batch in versions of a snapshot."""
    versions, last = snapshots.Versions(spark), {"n": -1}
    add = snapshots.counting(versions, ["event_type"], "event_type string, frequency long")

    def run(batch: DataFrame, number: int) -> None:
        add(batch, number)
        last["n"] = number

    stream = jobs.replay(spark, f"{sf}/events.parquet", files=1).writeStream.foreachBatch(run)
    stream.option("checkpointLocation", f"{versions.folder}/state").trigger(availableNow=True).start().awaitTermination()
    return versions.read(last["n"], "event_type string, frequency long")


@query("""SELECT user_id, event_id AS produced_id, later.event_id AS consumed_id, epoch_us(later.ts) - epoch_us(ts) AS wait_micros FROM (
  SELECT user_id, event_id, ts, event_type, first_value(CASE WHEN event_type = 'purchase' THEN {'event_id': event_id, 'ts': ts} END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM events) WHERE event_type = 'signup'""")
def next_purchase(spark, sf):
    own = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.next_waits(own, "user_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query("""SELECT *, greatest(ready - done, 0) AS open, done >= ready AS finished FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS ready, count(*) FILTER (event_type = 'purchase') AS done FROM events GROUP BY user_id)""")
def worker_completion(spark, sf):
    return jobs.completion(table(spark, sf, "events"), "user_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query("""WITH a AS (SELECT event_id, ts, max(ts) OVER (ORDER BY md5(event_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events)
SELECT event_id, epoch_us(latest) - epoch_us(ts) AS behind_micros FROM a WHERE ts < latest - INTERVAL 20 DAY""")
def late_events(spark, sf):
    """Events that arrive in a drawn order, and a watermark of twenty days would drop."""
    own = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("arrival", F.md5(F.col("event_id").cast("string")))
    out = jobs.late_rows(own, "arrival", F.substring("arrival", 1, 3), "20 DAYS")
    return out.select("event_id", (F.unix_micros("latest") - F.unix_micros("ts")).alias("behind_micros"))


@query("""SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type""")
def approximate_users(spark, sf):
    """Exact users of each event type, and whether the sketch of 1 % is within 5 % of them."""
    # pairs first: beside a distinct count a sketch of 1 %, 13 KB, would be kept for every user of a type
    pairs = table(spark, sf, "events").select("event_type", "user_id").distinct()
    out = pairs.groupBy("event_type").agg(F.count("user_id").alias("users"), F.approx_count_distinct("user_id", 0.01).alias("sketch"))
    return out.select("event_type", "users", (F.abs(F.col("sketch") - F.col("users")) <= 0.05 * F.col("users")).alias("close"))


VERBS = text.VERBS.replace(" ", "|")


@query(rf"""WITH t AS (SELECT p_partkey, 'Pick the ' || p_name || ' then place it on the ' || lower(p_type) || ' then admire it then  Slide it back ' AS x FROM part)
SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(trim(x)), '\s+then\s+'), lambda p: regexp_extract(trim(p), '^({VERBS})\b', 1)), lambda v: v <> ''), ',') AS verbs FROM t""")
def instruction_verbs(spark, sf):
    made = F.concat(F.lit("Pick the "), "p_name", F.lit(" then place it on the "), F.lower("p_type"), F.lit(" then admire it then  Slide it back "))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.leading_verbs(made), ",").alias("verbs"))


@query("""SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS from_nouns, CASE WHEN p_size > 25 THEN 'shared box' ELSE lower(split_part(p_name, ' ', 2)) END AS from_left,
  CASE WHEN p_size > 25 THEN 'the ' || p_name || ' is moved' ELSE 'push the ' || p_name END AS instruction, CASE WHEN p_size > 25 THEN '' ELSE 'push' END AS verbs FROM part""")
def stored_manifest(spark, sf):
    big = F.col("p_size") > 25
    nouns = F.split("p_name", " ")
    own = table(spark, sf, "part").withColumn("task", F.when(big, F.concat(F.lit(" the "), "p_name", F.lit(" is moved "))))
    fields = text.stored_fields(F.col("task"), F.concat(F.lit("push the "), "p_name"), F.lit(None).cast("array<string>"), nouns, F.lit(""), F.lit(None).cast("string"))
    left = text.primary_object(F.when(big, " Shared Box "), F.array(F.get(nouns, 1)), nouns)
    return own.select("p_partkey", fields.alias("f"), left.alias("from_left")).select("p_partkey", F.col("f.primary_object").alias("from_nouns"), "from_left", "f.instruction", F.array_join("f.verbs", ",").alias("verbs"))


@query(rf"""WITH {ANSWERED} SELECT conv_id, turn, regexp_replace(trim(regexp_extract(instruction, '(?is)left hand:\s*(.+?)\s*right hand:', 1), E' \t\n\r'), '[.]+$', '') AS left_part,
  regexp_replace(trim(regexp_extract(instruction, '(?is)right hand:\s*(.+?)$', 1), E' \t\n\r'), '[.]+$', '') AS right_part,
  CASE WHEN instruction LIKE '%Right hand: None.' THEN 'left' ELSE 'bimanual' END AS hand_mode FROM answered""")
def combined_hands(spark, sf):
    own = answered(spark, sf).select("conv_id", "turn", text.combined_hand(F.col("instruction"), "left").alias("left_part"), text.combined_hand(F.col("instruction"), "right").alias("right_part"))
    return own.withColumn("hand_mode", text.hand_mode(F.col("left_part"), F.col("right_part")))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Left hand: lift the ' || p_name || '. Right hand: None.' ELSE 'Left hand: None. Right hand: lift the ' || p_name || '.' END AS instruction,
  'lift the ' || p_name AS task, CASE WHEN p_size > 25 THEN 'LEFT hand lifts the ' ELSE 'RIGHT hand lifts the ' END || p_name AS augmented FROM part""")
def single_arm_rows(spark, sf):
    told = F.concat(F.lit("The RIGHT hand enters from the bottom-right of the frame. Only the right hand is used: RIGHT hand lifts the "), "p_name")
    fields = text.single_arm_fields(F.concat(F.lit("lift the "), "p_name", F.lit(". ")), text.without_openings(told), F.when(F.col("p_size") > 25, "left").otherwise("right"))
    own = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), 50_000, "p_partkey")
    return own.select("p_partkey", fields.alias("f")).select("p_partkey", "f.instruction", "f.task", "f.augmented")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'open the ' || p_name || '|return home' ELSE 'open the ' || p_name || '|lift it|return home' END AS segments,
  CASE WHEN p_size > 40 THEN 'Left: None. | Right: ' || p_name ELSE 'Left: ' || p_name || ' | Right: ' || p_type END AS overlay FROM part""")
def segment_texts(spark, sf):
    texts = text.segment_texts(F.concat(F.lit("open the "), "p_name", F.lit(" and lift the lid")), F.when(F.col("p_size") > 25, 1).otherwise(2))
    line = F.when(F.col("p_size") > 40, text.overlay(F.col("p_name"), F.lit(None), F.lit("right"))).otherwise(text.overlay(F.col("p_name"), F.col("p_type"), F.lit("left")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(texts, "|").alias("segments"), line.alias("overlay"))


STOPS = ", ".join(f"'{w}'" for w in text.STOPWORDS.split())


@query(rf"""WITH {SPOKEN} SELECT DISTINCT word, regexp_full_match(word, '[a-z]{{3,24}}') AND word NOT IN ({STOPS}) AS slot_word,
  regexp_full_match(word, '[\s\S]{{3,}}(?:{text.NOUN_ENDINGS.replace(' ', '|')})') AS noun_like FROM spoken WHERE role = 'user'""")
def slot_words(spark, sf):
    return spoken(spark, sf, "user").select("word", text.is_slot_word(F.col("word"), F.lit(False)).alias("slot_word"), text.is_likely_noun(F.col("word")).alias("noun_like"))


@query("""WITH a AS (SELECT 'ds_v' || p_size || '_ep_' || p_partkey AS name FROM part), v AS (SELECT DISTINCT 'v' || p_size AS stem FROM part UNION SELECT DISTINCT 'p_' || p_size FROM part UNION SELECT 's_v1' UNION SELECT 'absent')
SELECT stem, coalesce((SELECT min(name) FROM a WHERE name LIKE '%\\_' || stem || '\\_ep\\_%' ESCAPE '\\'), (SELECT min(name) FROM a WHERE contains(name, stem))) AS name FROM v""".replace("\\\\", "\\"))
def annotations_of_videos(spark, sf):
    parts, size = table(spark, sf, "part"), F.col("p_size").cast("string")
    names = parts.select(F.concat(F.lit("ds_v"), size, F.lit("_ep_"), F.col("p_partkey").cast("string")).alias("name"))
    odd = spark.createDataFrame([("s_v1",), ("absent",)], "stem string")
    stems = parts.select(F.concat(F.lit("v"), size).alias("stem")).union(parts.select(F.concat(F.lit("p_"), size))).union(odd).distinct()
    return lookup.annotation_of(stems, names)


@query("""SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def sample_chain(spark, sf):
    """Line items as samples, orders as episodes' frames, customers as episodes."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_idx"), F.col("o_custkey").alias("episode"))
    index = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(orders, F.col("frame_idx") == F.col("l_orderkey"), "left")
    frames = orders.withColumn("o_custkey", F.col("episode"))
    episodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("episode"), "c_name")
    return lookup.samples(index, episodes, frames).select("l_orderkey", "l_linenumber", "o_custkey", "c_name")


PLACED = """placed AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents)"""


@query(f"""WITH {PLACED}, s AS (SELECT source, {sql_draw('source', 'place')} AS at, row_number() OVER (PARTITION BY source ORDER BY {sql_draw('source', 'place')}, place) - 1 AS place FROM placed)
SELECT p.source, p.doc_id, s.at FROM placed p JOIN s USING (source, place)""")
def interleaved_sources(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    placed = lookup.rank_by(docs, "source", "doc_id", "doc_id", "place", bits=12)
    return lookup.interleaved(placed, "source", "place", draws.draw(SEED, F.col("source"), F.col("place"))).select("source", "doc_id", "at")


@query("""WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)::BIGINT)[1:64] AS ids FROM conversations),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS width FROM t)
SELECT conv_id, turn, width, md5(array_to_string(list_concat(list_transform(range(width - len(ids)), lambda i: -1), ids), ',')) AS left_padded, len(ids)::BIGINT AS tokens FROM w""")
def padded_turns(spark, sf):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    own = lookup.padded_tokens(table(spark, sf, "conversations").select("conv_id", "turn", ids.alias("ids")), "conv_id", "ids", -1, "left", 64)
    tokens = F.aggregate("mask", F.lit(0).cast("long"), lambda a, v: a + v)
    return own.select("conv_id", "turn", F.size("padded").cast("long").alias("width"), F.md5(F.array_join("padded", ",")).alias("left_padded"), tokens.alias("tokens"))


@query(r"""SELECT source, count(*) AS total, count(*) FILTER (n_chars >= 500) AS kept, coalesce(sum(len(string_split(text, chr(10)))) FILTER (n_chars >= 500), 0)::BIGINT AS segments,
  count(*) - count(*) FILTER (n_chars >= 500) AS filtered FROM documents GROUP BY source""")
def document_funnel(spark, sf):
    return lookup.funnel(table(spark, sf, "documents"), "source", F.col("n_chars") >= 500, F.size(F.split("text", "\n")))


NUMBERED = "numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)"


def numbered(spark, sf) -> DataFrame:
    return sampling.ordinal(table(spark, sf, "orders").select("o_orderkey"), F.shiftright("o_orderkey", 12), [F.col("o_orderkey")], "place")


@query(f"WITH {NUMBERED} SELECT o_orderkey, place, place // 64 AS chunk, place % 7 AS worker FROM numbered")
def chunk_forms(spark, sf):
    return sampling.round_robin(sampling.fixed_chunks(numbered(spark, sf), "place", 64), "place", 7).select("o_orderkey", "place", "chunk", F.col("worker").cast("long").alias("worker"))


@query(f"""WITH {NUMBERED}, t AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey, place FROM numbered UNION ALL SELECT o_orderkey, place + n FROM numbered, t WHERE n % 256 > 0 AND place < 256 - n % 256""")
def padded_epoch(spark, sf):
    total = table(spark, sf, "orders").count()
    return sampling.full_batches(numbered(spark, sf), "place", total, 256, pad=True).select("o_orderkey", "place")


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS other FROM events GROUP BY user_id")
def outcome_summary(spark, sf):
    return sampling.outcomes(table(spark, sf, "events"), "user_id", "event_type", ["purchase", "error"])


@query("SELECT event_id, user_id FROM events WHERE event_id::VARCHAR NOT IN (SELECT event_id::VARCHAR FROM events WHERE event_type = 'error')")
def stream_unprocessed(spark, sf):
    done = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"))
    stream = jobs.unprocessed(jobs.replay(spark, f"{sf}/events.parquet", files=8), done, F.col("event_id").cast("string"))
    return jobs.drained(stream.select("event_id", "user_id"))
