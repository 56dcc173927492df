"""Further queries: scenes, draws, training rows and checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators import draws, episodes, sampling, scenes, vocabulary
from reelspan.plans.queries import FRAMES, WORDS, frames, query, words
from reelspan.sources.tables import table

SEED = 17


def sql_draw(*keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(f'{k}::VARCHAR' for k in keys)})), 1, 8))::BIGINT"


BOXES = """boxes AS (SELECT l_orderkey AS scene, l_linenumber AS n, l_partkey AS k, (l_partkey % 900)::DOUBLE AS x, (l_suppkey * 7 % 900)::DOUBLE AS y,
  20 + l_quantity * 8 AS w, 20 + l_quantity * 8 AS h FROM lineitem)"""
PAIRS = f"""{BOXES}, pairs AS (SELECT a.scene, a.n AS n1, a.k AS k1, b.n AS n2, b.k AS k2, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS qx, b.y AS qy, b.w AS qw, b.h AS qh
  FROM boxes a JOIN boxes b ON a.scene = b.scene AND (a.n, a.k) <> (b.n, b.k))"""


def box_pairs(spark, sf: str) -> DataFrame:
    side = 20 + F.col("l_quantity") * 8
    box = F.struct((F.col("l_partkey") % 900).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 900).cast("double").alias("y"), side.alias("w"), side.alias("h"))
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("n1"), F.col("l_partkey").alias("k1"), box.alias("a"))
    b = a.toDF("scene", "n2", "k2", "b")
    return a.join(b, "scene").filter((F.col("n1") != F.col("n2")) | (F.col("k1") != F.col("k2")))


@query(f"""WITH {PAIRS} SELECT scene, n1, k1, n2, k2 FROM pairs
WHERE ax + aw / 2 BETWEEN qx - 35 AND qx + qw + 35 AND ay + ah / 2 BETWEEN qy - 35 AND qy + qh + 35
  AND greatest(least(ax + aw, qx + qw) - greatest(ax, qx), 0) * greatest(least(ay + ah, qy + qh) - greatest(ay, qy), 0) >= 0.2 * aw * ah""")
def resting_on(spark, sf):
    return box_pairs(spark, sf).filter(scenes.rests_on("a", "b")).select("scene", "n1", "k1", "n2", "k2")


@query(f"""WITH {PAIRS}, g AS (SELECT *, greatest(ax - qx - qw, qx - ax - aw, 0) AS hg, greatest(ay - qy - qh, qy - ay - ah, 0) AS vg,
  greatest(least(ax + aw, qx + qw) - greatest(ax, qx), 0) * greatest(least(ay + ah, qy + qh) - greatest(ay, qy), 0) AS shared FROM pairs)
SELECT scene, n1, k1, n2, k2, least(hg, vg) AS gap FROM g WHERE least(hg, vg) < 90 AND shared <= 0.15 * least(aw * ah, qw * qh)""")
def adjacent_objects(spark, sf):
    near = box_pairs(spark, sf).filter(scenes.adjacent("a", "b"))
    return near.select("scene", "n1", "k1", "n2", "k2", F.least(*scenes.gaps("a", "b")).alias("gap"))


OBJECTS = """objects AS (SELECT l_orderkey AS scene, l_linenumber AS n, l_partkey AS k, split_part(p_name, ' ', 2) AS noun,
  CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS class FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def scene_objects(spark, sf: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))
    rows = table(spark, sf, "lineitem").join(parts, "l_partkey")
    return rows.select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), "noun", kind.alias("class"))


@query(f"""WITH {OBJECTS} SELECT scene, noun, k FROM (SELECT scene, noun, k, row_number() OVER (PARTITION BY scene, noun ORDER BY k) AS r FROM objects o
  WHERE class = 2 AND NOT EXISTS (SELECT 1 FROM objects v WHERE v.scene = o.scene AND v.noun = o.noun AND v.class < 2)) WHERE r = 1""")
def suggested_without_visible(spark, sf):
    rows = scene_objects(spark, sf)
    out = scenes.without_known(rows.filter("class = 2"), rows.filter("class < 2"), "scene", "noun", "k")
    return out.select("scene", "noun", "k")


@query(f"""WITH {OBJECTS} SELECT scene, noun, class, k FROM (SELECT *, row_number() OVER (PARTITION BY scene, noun ORDER BY class, k) AS r FROM objects) WHERE r = 1""")
def catalogue_union(spark, sf):
    return scenes.distinct_by_class(scene_objects(spark, sf), "scene", "noun", "class", "k").select("scene", "noun", "class", "k")


FACTS = {
    "both_hands": "l_tax >= 0.04", "holding": "l_returnflag <> 'N'", "grasps_held": "l_quantity <= 5", "operates_held": "l_quantity <= 20", "uses": "l_linestatus = 'F'",
    "puts_down": "l_partkey % 2 = 0", "primary_held": "l_quantity <= 35", "involves_held": "l_quantity <= 42", "lays": "l_suppkey % 3 = 0", "two_objects": "l_linenumber % 2 = 0",
}


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"{v} AS {k}" for k, v in FACTS.items())} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN both_hands THEN 50 ELSE 0 END + CASE WHEN two_objects THEN 3 ELSE 0 END
  + CASE WHEN NOT holding AND lays THEN 4 WHEN NOT holding THEN 0 WHEN grasps_held THEN -100 WHEN operates_held AND uses THEN 60 WHEN operates_held THEN 40
         WHEN puts_down AND primary_held THEN 18 WHEN primary_held THEN 8 WHEN involves_held THEN 4 ELSE -100 END AS score FROM f""")
def feasibility_score(spark, sf):
    score = scenes.feasibility({k: F.expr(v) for k, v in FACTS.items()})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"))


@query(f"SELECT o_orderkey FROM orders WHERE {sql_draw('o_orderkey')} < {int(0.3 * (1 << 32))}")
def bernoulli_selection(spark, sf):
    return table(spark, sf, "orders").filter(draws.chosen(SEED, 0.3, F.col("o_orderkey"))).select("o_orderkey")


@query(f"""WITH {WORDS}, w AS (SELECT word_type, word, max(frequency) OVER (PARTITION BY word_type) - frequency + 1 AS weight FROM words),
r AS (SELECT word_type, word, sum(weight) OVER (PARTITION BY word_type ORDER BY word) AS hi, weight FROM w),
t AS (SELECT word_type, max(hi)::BIGINT AS total, d AS draw FROM r, range(25) x(d) GROUP BY ALL),
a AS (SELECT *, ({sql_draw('word_type', 'draw')} * total) >> 32 AS aim FROM t)
SELECT a.word_type, a.draw, r.word FROM a JOIN r ON a.word_type = r.word_type AND aim >= hi - weight AND aim < hi""")
def weighted_draws(spark, sf):
    own = words(spark, sf)
    heavy = own.withColumn("weight", F.max("frequency").over(Window.partitionBy("word_type")) - F.col("frequency") + 1)
    return draws.weighted_draws(heavy, "word_type", "word", "weight", 25, SEED)


@query(f"""WITH {WORDS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_type, frequency ORDER BY {sql_draw('word')}, word) AS place FROM words) WHERE place <= 1""")
def balanced_words(spark, sf):
    return draws.balanced_picks(words(spark, sf), "word_type", "frequency", "word", 1, SEED)


@query(f"""SELECT source, doc_id, p AS epoch_pass, row_number() OVER (PARTITION BY source, p ORDER BY {sql_draw('p', 'doc_id')}, doc_id) - 1 AS place FROM documents, range(2) t(p)""")
def epoch_order(spark, sf):
    return draws.epoch_order(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 2, SEED)


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, i % 4 AS replica, i // 4 // 32 AS batch FROM n""")
def replica_batches(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    bucket = F.floor((F.col("o_orderkey") - F.lit(low)) * sampling.BUCKETS / F.lit(max(high - low + 1, 1)))
    numbered = sampling.ordinal(orders, bucket, [F.col("o_orderkey")], "i")
    return numbered.select("o_orderkey", (F.col("i") % 4).alias("replica"), F.floor(F.floor(F.col("i") / 4) / 32).alias("batch"))


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
c AS (SELECT source, n, sum(n) OVER (ORDER BY source) AS hi FROM s), t AS (SELECT sum(n)::BIGINT AS total FROM s)
SELECT o_orderkey, source, (o_orderkey * 31 % total - (hi - n))::BIGINT AS local_index FROM orders, t JOIN c ON o_orderkey * 31 % total >= hi - n AND o_orderkey * 31 % total < hi""")
def global_index_lookup(spark, sf):
    sizes = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))  # a row a dataset
    ends = sizes.withColumn("_hi", F.sum("n").over(Window.orderBy("source"))).withColumn("_total", F.sum("n").over(Window.partitionBy()))
    asked = table(spark, sf, "orders").select("o_orderkey").crossJoin(F.broadcast(ends.select(F.max("_total").alias("_all")).limit(1)))
    at = F.col("o_orderkey") * 31 % F.col("_all")
    found = asked.withColumn("_at", at).join(F.broadcast(ends), (F.col("_at") >= F.col("_hi") - F.col("n")) & (F.col("_at") < F.col("_hi")))
    return found.select("o_orderkey", "source", (F.col("_at") - F.col("_hi") + F.col("n")).alias("local_index"))


@query("""SELECT vec_id, len([x for x in embedding if x > 0]) AS kept, round(coalesce([x for x in embedding if x > 0][1], 0)::DOUBLE, 6) AS first_kept FROM embeddings""")
def mask_compaction(spark, sf):
    own = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    front = F.filter("e", lambda x: x > 0)
    whole = F.concat(front, F.array_repeat(F.lit(0.0), F.size("e") - F.size(front)))
    return own.select("vec_id", F.size(front).alias("kept"), F.round(F.get(whole, 0), 6).alias("first_kept"))


@query(f"""WITH {FRAMES} SELECT episode, frame_idx FROM (SELECT episode, frame_idx, row_number() OVER (PARTITION BY episode ORDER BY frame_idx DESC) AS r FROM frames WHERE event_type = 'click') WHERE r <= 3""")
def last_masked_frames(spark, sf):
    w = Window.partitionBy("episode").orderBy(F.desc("frame_idx"))
    return frames(spark, sf).filter("event_type = 'click'").withColumn("_r", F.row_number().over(w)).filter("_r <= 3").select("episode", "frame_idx")


@query(f"""WITH {FRAMES}, n AS (SELECT episode, count(*) AS n FROM frames GROUP BY episode)
SELECT f.episode, f.frame_idx, o AS slot, least(greatest(f.frame_idx + o, 0), n - 1)::BIGINT AS source_frame, f.frame_idx + o NOT BETWEEN 0 AND n - 1 AS outside FROM frames f JOIN n USING (episode), range(-2, 3) t(o)""")
def window_indices(spark, sf):
    own = frames(spark, sf).select("episode", "frame_idx")
    sizes = own.groupBy("episode").agg(F.count("*").alias("n"))
    many = own.join(sizes, "episode").withColumn("slot", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    at = F.col("frame_idx") + F.col("slot")
    return many.select("episode", "frame_idx", "slot", F.least(F.greatest(at, F.lit(0)), F.col("n") - 1).alias("source_frame"), ((at < 0) | (at >= F.col("n"))).alias("outside"))


@query(f"""WITH {FRAMES}, s AS (SELECT episode, 10 + episode % 5 AS a, 25 + episode % 9 AS b FROM (SELECT DISTINCT episode FROM frames))
SELECT episode, g AS segment, frame_idx, frame_idx - CASE g WHEN 0 THEN 0 WHEN 1 THEN a ELSE b END AS local_frame
FROM frames JOIN s USING (episode), range(3) t(g) WHERE (g = 0 AND frame_idx <= a) OR (g = 1 AND frame_idx BETWEEN a AND b) OR (g = 2 AND frame_idx >= b)""")
def segment_slices(spark, sf):
    own = frames(spark, sf).select("episode", "frame_idx")
    a, b = 10 + F.col("episode") % 5, 25 + F.col("episode") % 9
    last = F.lit((1 << 31) - 1).cast("long")
    parts = F.array(*[F.struct(F.lit(i).alias("segment"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for i, (lo, hi) in enumerate([(F.lit(0), a), (a, b), (b, last)])])
    segments = own.select("episode").distinct().select("episode", F.explode(parts).alias("s")).select("episode", "s.*")
    found = own.join(segments, "episode").filter((F.col("frame_idx") >= F.col("lo")) & (F.col("frame_idx") <= F.col("hi")))
    return found.select("episode", "segment", "frame_idx", (F.col("frame_idx") - F.col("lo")).alias("local_frame"))


@query("""WITH t AS (SELECT conv_id, len(string_split(text, ' ')) AS n FROM conversations), c AS (SELECT conv_id, sum(n)::BIGINT AS tokens FROM t GROUP BY conv_id)
SELECT conv_id, conv_id % 16 AS batch, tokens, (max(tokens) OVER (PARTITION BY conv_id % 16))::BIGINT AS width, (max(tokens) OVER (PARTITION BY conv_id % 16) - tokens)::BIGINT AS padding FROM c""")
def padded_batches(spark, sf):
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.size(F.split("text", " "))).alias("tokens")).withColumn("batch", F.col("conv_id") % 16)
    widths = own.groupBy("batch").agg(F.max("tokens").alias("width"))
    return own.join(widths, "batch").select("conv_id", "batch", "tokens", "width", (F.col("width") - F.col("tokens")).alias("padding"))


@query("""SELECT l_returnflag, metric, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM
  (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE v) GROUP BY ALL""")
def metrics_by_mode(spark, sf):
    long = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax").unpivot("l_returnflag", ["l_quantity", "l_discount", "l_tax"], "metric", "v")
    return long.groupBy("l_returnflag", "metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("""WITH n AS (SELECT o_custkey, 'epoch=' || o_orderkey % 9 || '-step=' || printf('%06d', o_orderkey) || '.ckpt' AS name FROM orders)
SELECT o_custkey, arg_max(name, regexp_extract(name, 'step=(\\d+)', 1)::BIGINT) AS last_checkpoint, max(regexp_extract(name, 'step=(\\d+)', 1)::BIGINT) AS step FROM n GROUP BY o_custkey""".replace("\\\\", "\\"))
def last_checkpoints(spark, sf):
    name = F.format_string("epoch=%d-step=%06d.ckpt", F.col("o_orderkey") % 9, F.col("o_orderkey"))
    step = F.regexp_extract("name", r"step=(\d+)", 1).cast("long")
    return table(spark, sf, "orders").select("o_custkey", name.alias("name")).groupBy("o_custkey").agg(F.max_by("name", step).alias("last_checkpoint"), F.max(step).alias("step"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS first_part, regexp_extract(url, '/(\d+)(?:[?#]|$)', 1) AS number FROM pages""")
def path_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, "^https?://[^/]+/([^/?#]*)", 1).alias("first_part"), F.regexp_extract(url, r"/(\d+)(?:[?#]|$)", 1).alias("number"))


@query("""SELECT o_orderkey, md5(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority)) AS row_id, 'task:' || printf('%08d', o_orderkey) AS task_id FROM orders""")
def stable_ids(spark, sf):
    own = F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", own.alias("row_id"), F.concat(F.lit("task:"), F.format_string("%08d", "o_orderkey")).alias("task_id"))


@query("""SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS unresolved_samples,
  (SELECT count(*) FROM lineitem WHERE l_quantity < 0 OR l_linenumber < 1) AS out_of_range, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS repeated_ids""")
def quality_report(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    lost = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count("*").alias("unresolved_samples"))
    odd = lines.agg(F.count_if((F.col("l_quantity") < 0) | (F.col("l_linenumber") < 1)).alias("out_of_range"))
    again = orders.agg((F.count("*") - F.countDistinct("o_orderkey")).alias("repeated_ids"))
    return lost.crossJoin(odd).crossJoin(again)  # one row each


@query(f"WITH {FRAMES} SELECT episode, count(*) AS frames, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END), 6) AS kept_ratio FROM frames GROUP BY episode HAVING avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END) >= 0.75")
def tracked_episodes(spark, sf):
    kept = F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0))
    own = table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("frames"), kept.alias("_k"))
    return own.filter("_k >= 0.75").select("episode", "frames", F.round("_k", 6).alias("kept_ratio"))


@query(f"""WITH {FRAMES}, d AS (SELECT episode, frame_idx, event_type, row_number() OVER (PARTITION BY episode, frame_idx // 8, event_type ORDER BY frame_idx) AS r FROM frames)
SELECT episode, frame_idx // 8 AS bucket, event_type, frame_idx FROM d WHERE r = 1""")
def first_detection_per_hand(spark, sf):
    own = frames(spark, sf).select("episode", F.floor(F.col("frame_idx") / 8).alias("bucket"), "event_type", "frame_idx")
    return own.groupBy("episode", "bucket", "event_type").agg(F.min("frame_idx").alias("frame_idx"))


@query(f"""WITH {FRAMES}, k AS (SELECT episode, frame_idx, CASE WHEN event_type <> 'error' THEN signal END AS s FROM frames),
d AS (SELECT episode, sum(abs(s - p)) AS path FROM (SELECT episode, s, lag(s) OVER (PARTITION BY episode ORDER BY frame_idx) AS p FROM k WHERE s IS NOT NULL) GROUP BY episode),
n AS (SELECT episode, count(*) AS frames FROM k GROUP BY episode)
SELECT episode, round(coalesce(path, 0) / greatest(frames - 1, 1), 6) AS wrist_speed FROM n LEFT JOIN d USING (episode)""")
def wrist_speed(spark, sf):
    out = episodes.hand_summary(frames(spark, sf), {"left": F.col("event_type") != "error", "right": F.lit(False)})
    return out.select("episode", F.round("avg_speed", 6).alias("wrist_speed"))


@query(f"""WITH {FRAMES}, k AS (SELECT episode, frame_idx, CASE WHEN event_type <> 'error' THEN signal END AS s FROM frames)
SELECT episode, round(sum(abs(s - p)), 4) AS path FROM (SELECT episode, s, lag(s) OVER (PARTITION BY episode ORDER BY frame_idx) AS p FROM k WHERE s IS NOT NULL) GROUP BY episode""")
def wrist_path(spark, sf):
    kept = frames(spark, sf).filter("event_type <> 'error'")
    moved = kept.withColumn("_d", F.abs(F.col("signal") - F.lag("signal").over(episodes.by_frame())))
    return moved.groupBy("episode").agg(F.round(F.sum("_d"), 4).alias("path"))


@query(f"""WITH {WORDS}, d AS (SELECT DISTINCT word AS w FROM words)
SELECT x.w AS a, y.w AS b FROM d x JOIN d y ON x.w < y.w WHERE (length(x.w) > 4 AND length(y.w) > 4 AND left(x.w, 4) = left(y.w, 4))
  OR (abs(length(x.w) - length(y.w)) <= 2 AND len([i for i in range(1, least(length(x.w), length(y.w)) + 1) if x.w[i] <> y.w[i]]) <= 2)""")
def near_duplicate_words(spark, sf):
    return vocabulary.near_pairs(words(spark, sf), "word")


@query("SELECT p_partkey, 'take the ' || p_name || ' and put it on the ' || split_part(p_name, ' ', 2) || ' box' AS instruction FROM part")
def filled_templates(spark, sf):
    slots = F.create_map(F.lit("noun"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("adjective"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    text = F.lit("take the {adjective} {noun} and put it on the {missing} {noun} box")
    return table(spark, sf, "part").select("p_partkey", vocabulary.fill(text, slots).alias("instruction"))
