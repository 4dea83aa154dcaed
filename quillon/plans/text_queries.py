"""Queries over text, times, JSON, hashes and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import phrases as P
from .fixtures import IV, intervals, table
from .ranking_queries import STEM, STOP, TOK
from .registry import query


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))) AS h FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("h"))


@query(f"SELECT doc_id, len({TOK}) AS n, array_to_string(list_slice({TOK}, 1, 5), ' ') AS head FROM documents")
def bm25_tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@query(f"SELECT item_id, unnest(list_distinct(list_transform(list_filter({TOK}, lambda w: NOT list_contains({STOP}, w)), lambda w: {STEM}))) AS stem FROM benchmark")
def stem_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(T.stems(F.col("text"))).alias("stem"))


_NG = f"b AS (SELECT item_id, {TOK} AS w FROM benchmark), g AS (SELECT item_id, n, unnest(CASE WHEN len(w) >= n THEN list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' ')) ELSE [] END) AS g FROM b, (SELECT unnest([1, 2, 3, 4]) AS n)), gc AS (SELECT item_id, n, g, count(*) AS c FROM g GROUP BY ALL)"


def _grams(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("w"))
    parts = [b.select("item_id", F.lit(n).alias("n"), F.explode(T.ngrams(F.col("w"), n)).alias("g")) for n in (1, 2, 3, 4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("item_id", "n", "g").agg(F.count("*").alias("c"))


@query(f"WITH {_NG} SELECT item_id, n, g, c FROM gc WHERE n = 2")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _grams(spark, d).where("n = 2")


@query(f"""WITH {_NG}, pr AS (SELECT x.item_id AS cand, x.item_id + 1 AS ref FROM benchmark x WHERE x.item_id + 1 IN (SELECT item_id FROM benchmark)), ln AS (SELECT item_id, len(w) AS l FROM b),
t AS (SELECT cand, ref, n, sum(c)::DOUBLE AS total FROM pr JOIN gc ON item_id = cand GROUP BY ALL), m AS (SELECT cand, x.n, sum(least(x.c, y.c))::DOUBLE AS hit FROM pr JOIN gc x ON x.item_id = cand JOIN gc y ON y.item_id = ref AND y.n = x.n AND y.g = x.g GROUP BY ALL),
p AS (SELECT t.cand, t.ref, sum(ln(CASE WHEN coalesce(hit, 0) > 0 THEN hit ELSE 0.1 END / total)) / 4 AS lp FROM t LEFT JOIN m USING (cand, n) GROUP BY ALL)
SELECT cand, ref, round(exp(least(0, 1 - r.l / c.l) + lp), 6) AS bleu FROM p JOIN ln c ON c.item_id = cand JOIN ln r ON r.item_id = ref""")
def bleu4(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark passage against the next: clipped precisions, 0.1 for none, brevity penalty."""
    g = _grams(spark, d)
    ids = table(spark, d, "benchmark").select(F.col("item_id"), F.size(T.tokens(F.col("text"))).alias("l"))
    pr = ids.select(F.col("item_id").alias("cand"), F.col("l").alias("lc")).join(ids.select((F.col("item_id") - 1).alias("cand"), F.col("item_id").alias("ref"), F.col("l").alias("lr")), "cand")
    x = pr.join(g.withColumnRenamed("item_id", "cand"), "cand")
    y = g.select(F.col("item_id").alias("ref"), "n", "g", F.col("c").alias("rc"))
    j = x.join(y, ["ref", "n", "g"], "left").groupBy("cand", "ref", "lc", "lr", "n").agg(F.sum("c").alias("total"), F.sum(F.least("c", F.coalesce("rc", F.lit(0)))).alias("hit"))
    lp = F.sum(F.log(F.when(F.col("hit") > 0, F.col("hit")).otherwise(0.1) / F.col("total"))) / 4
    return j.groupBy("cand", "ref", "lc", "lr").agg(lp.alias("lp")).select("cand", "ref", F.round(F.exp(F.least(F.lit(0.0), 1 - F.col("lr") / F.col("lc")) + F.col("lp")), 6).alias("bleu"))


@query(f"""WITH {_NG}, nd AS (SELECT count(*) AS nd FROM benchmark), df AS (SELECT n, g, count(*) AS df FROM gc GROUP BY ALL), tot AS (SELECT item_id, n, sum(c) AS tot FROM gc GROUP BY ALL),
v AS (SELECT item_id, n, g, c / tot * ln((nd + 1) / (df + 1)) AS x FROM gc JOIN df USING (n, g) JOIN tot USING (item_id, n), nd), nm AS (SELECT item_id, n, sqrt(sum(x * x)) AS nm FROM v GROUP BY ALL),
s AS (SELECT a.item_id AS cand, a.n, sum(a.x * b.x) AS s FROM v a JOIN v b ON b.item_id = a.item_id + 1 AND a.n = b.n AND a.g = b.g GROUP BY ALL)
SELECT s.cand, round(10 * sum(CASE WHEN p.nm > 0 AND q.nm > 0 THEN s / (p.nm * q.nm) ELSE 0 END) / 4, 6) AS cider FROM s JOIN nm p ON p.item_id = s.cand AND p.n = s.n JOIN nm q ON q.item_id = s.cand + 1 AND q.n = s.n GROUP BY s.cand""")
def cider_like(spark: SparkSession, d: str) -> DataFrame:
    g = _grams(spark, d)
    nd = table(spark, d, "benchmark").agg(F.count("*").alias("nd"))
    df = g.groupBy("n", "g").agg(F.count("*").alias("df"))
    tot = g.groupBy("item_id", "n").agg(F.sum("c").alias("tot"))
    v = g.join(df, ["n", "g"]).join(tot, ["item_id", "n"]).crossJoin(F.broadcast(nd)).select("item_id", "n", "g", (F.col("c") / F.col("tot") * F.log((F.col("nd") + 1) / (F.col("df") + 1))).alias("x"))
    nm = v.groupBy("item_id", "n").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nm"))
    b = v.select((F.col("item_id") - 1).alias("item_id"), "n", "g", F.col("x").alias("y"))
    s = v.join(b, ["item_id", "n", "g"]).groupBy("item_id", "n").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    s = s.join(nm, ["item_id", "n"]).join(nm.select((F.col("item_id") - 1).alias("item_id"), "n", F.col("nm").alias("nq")), ["item_id", "n"])
    return s.groupBy(F.col("item_id").alias("cand")).agg(F.round(10 * F.sum(F.when((F.col("nm") > 0) & (F.col("nq") > 0), F.col("s") / (F.col("nm") * F.col("nq"))).otherwise(0.0)) / 4, 6).alias("cider"))


@query(r"WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) SELECT conv_id, turn, trim(text) = trim(nx) AS exact, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) = trim(regexp_replace(lower(nx), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalised FROM c WHERE nx IS NOT NULL")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("nx", F.lead("text").over(w)).where("nx is not null")
    return c.select("conv_id", "turn", (F.trim("text") == F.trim("nx")).alias("exact"), (T.normalize_text(F.col("text")) == T.normalize_text(F.col("nx"))).alias("normalised"))


_ANSWERED = """(SELECT doc_id, chr((65 + n_chars % 7)::INTEGER) AS l, CASE doc_id % 7 WHEN 0 THEN text || ' <answer> (' || l || ') </answer>' WHEN 1 THEN text || ' I take [' || lower(l) || ']' WHEN 2 THEN text || ' The answer is ' || l || '.'
 WHEN 3 THEN ' ' || lower(l) || ' ' WHEN 4 THEN text WHEN 5 THEN text || ' option: ' || lower(l) ELSE l || ')' END AS s FROM (SELECT *, chr((65 + n_chars % 7)::INTEGER) AS l FROM documents))"""


@query(f"WITH a AS {_ANSWERED} SELECT doc_id, coalesce(nullif(upper(regexp_extract(s, '(?i)<answer>\\s*\\(?([A-E])\\)?\\s*</answer>', 1)), ''), nullif(upper(regexp_extract(s, '[\\(\\[]([A-Ea-e])[\\)\\]]', 1)), ''), nullif(upper(regexp_extract(s, '(?i)(?:answer|option|choice)\\s*(?:is|:)?\\s*([A-E])\\b', 1)), ''), nullif(upper(regexp_extract(s, '^\\s*([A-Ea-e])\\s*[.)]?\\s*$', 1)), '')) AS choice FROM a")
def parse_choice(spark: SparkSession, d: str) -> DataFrame:
    """Choices after whole texts, in tags, brackets and words, and alone; some letters are none."""
    i, l = F.col("doc_id") % 7, F.chr((65 + F.col("n_chars") % 7).cast("int"))
    after = lambda *x: F.concat("text", *[c if not isinstance(c, str) else F.lit(c) for c in x])
    a = (
        F.when(i == 0, after(" <answer> (", l, ") </answer>")).when(i == 1, after(" I take [", F.lower(l), "]")).when(i == 2, after(" The answer is ", l, ".")).when(i == 3, F.concat(F.lit(" "), F.lower(l), F.lit(" ")))
        .when(i == 4, F.col("text")).when(i == 5, after(" option: ", F.lower(l))).otherwise(F.concat(l, F.lit(")")))
    )
    return _docs(spark, d).select("doc_id", T.parse_choice(a).alias("choice"))


@query("WITH o AS (SELECT item_id, lower(text) AS t, string_split(lower(text), ' ') AS w FROM benchmark), x AS (SELECT item_id, t, unnest([{'k': 'A', 'o': w[1]}, {'k': 'B', 'o': w[2] || ' ' || w[3]}, {'k': 'C', 'o': 'zzz'}]) AS x FROM o) SELECT item_id, arg_max(x.k, (length(x.o), -ascii(x.k))) AS choice FROM x WHERE contains(t, x.o) GROUP BY item_id")
def parse_choice_smart(spark: SparkSession, d: str) -> DataFrame:
    """The longest option that the answer contains, the first of equals."""
    o = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("t")).withColumn("w", F.split("t", " "))
    opts = F.array(F.struct(F.lit("A").alias("k"), F.col("w")[0].alias("o")), F.struct(F.lit("B").alias("k"), F.concat_ws(" ", F.col("w")[1], F.col("w")[2]).alias("o")), F.struct(F.lit("C").alias("k"), F.lit("zzz").alias("o")))
    hit = F.filter(opts, lambda x: F.col("t").contains(x["o"]))
    best = F.array_max(F.transform(hit, lambda x: F.struct(F.char_length(x["o"]).alias("n"), (-F.ascii(x["k"])).alias("f"), x["k"].alias("k"))))
    return o.select("item_id", best["k"].alias("choice")).where("choice is not null")


@query(r"WITH a AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' so OPTION_INDEX=' || (n_chars % 50) || ' ' WHEN 1 THEN ' OPTION_INDEX=null' ELSE ' none' END AS s, doc_id % 2 = 0 AS answered FROM documents) SELECT doc_id, TRY_CAST(nullif(regexp_extract(s, 'OPTION_INDEX=(\d+)', 1), '') AS INTEGER) AS idx, CASE WHEN regexp_matches(s, 'OPTION_INDEX=\d+') THEN 'ok' WHEN regexp_matches(s, 'OPTION_INDEX=null') AND NOT answered THEN 'null' ELSE 'invalid' END AS state FROM a")
def parse_mc_marker(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    s = F.concat("text", F.when(i % 3 == 0, F.concat(F.lit(" so OPTION_INDEX="), (F.col("n_chars") % 50).cast("string"), F.lit(" "))).when(i % 3 == 1, " OPTION_INDEX=null").otherwise(" none"))
    state = F.when(s.rlike(r"OPTION_INDEX=\d+"), "ok").when(s.rlike("OPTION_INDEX=null") & (i % 2 != 0), "null").otherwise("invalid")
    return _docs(spark, d).select("doc_id", F.nullif(F.regexp_extract(s, r"OPTION_INDEX=(\d+)", 1), F.lit("")).try_cast("int").alias("idx"), state.alias("state"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS n, md5(array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), '|')) AS bodies FROM pages")
def final_tags(spark: SparkSession, d: str) -> DataFrame:
    """All bodies of a tag."""
    b = F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(b).cast("long").alias("n"), F.md5(F.array_join(b, "|").cast("binary")).alias("bodies"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/?]+)(\?|$)', 1), '_\d+$', '') AS stem FROM pages")
def video_id_from_annotation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"([^/?]+)(\?|$)", 1), r"_\d+$", "").alias("stem"))


@query()
def phrase_match_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Best window ratio of at least 0.85 by the sequence matcher, which SQL can't express; bounds that lose no match pass over most windows."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("phrase"))
    texts = _docs(spark, d).select("doc_id", "text")
    # a text costs far more to go through than to send, so large tables are dealt evenly too
    return P.windowed(texts.repartition(B.spread(texts)), b)


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock, value * 100 AS sec FROM (SELECT event_id, value, greatest(0, floor(value * 100))::BIGINT AS s FROM events)")
def sec_to_hhmmss(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("value") * 100
    return table(spark, d, "events").select("event_id", T.seconds_to_clock(s).alias("clock"), s.alias("sec"))


@query("""WITH c AS (SELECT event_id, (event_id % 90) || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ':30.5' ELSE ':x' END AS s FROM events), p AS (SELECT *, string_split(s, ':') AS p FROM c)
SELECT event_id, CASE len(p) WHEN 2 THEN TRY_CAST(p[1] AS DOUBLE) * 60 + TRY_CAST(p[2] AS DOUBLE) WHEN 3 THEN TRY_CAST(p[1] AS DOUBLE) * 3600 + TRY_CAST(p[2] AS DOUBLE) * 60 + TRY_CAST(p[3] AS DOUBLE) END AS sec FROM p""")
def clock_to_sec(spark: SparkSession, d: str) -> DataFrame:
    """Minutes may exceed 59, junk is null."""
    i = F.col("event_id")
    s = F.concat((i % 90).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.when(i % 3 == 0, "").when(i % 3 == 1, ":30.5").otherwise(":x"))
    return table(spark, d, "events").select("event_id", T.clock_to_seconds(s).alias("sec"))


@query(f"WITH {IV}, k AS (SELECT id, start_sec::BIGINT || '_' || end_sec::BIGINT AS doc FROM iv) SELECT id, CAST(split_part(doc, '_', 1) AS BIGINT) AS s, CAST(split_part(doc, '_', 2) AS BIGINT) AS e FROM k")
def doc_id_window(spark: SparkSession, d: str) -> DataFrame:
    doc = F.concat_ws("_", F.col("start_sec").cast("long").cast("string"), F.col("end_sec").cast("long").cast("string"))
    p = F.split(doc, "_")
    return intervals(spark, d).select("id", p[0].cast("long").alias("s"), p[1].cast("long").alias("e"))


@query("SELECT event_id, greatest(0, floor(value))::BIGINT AS s, least(120, ceil(value * 1.5))::BIGINT AS e, CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM events")
def canonical_span(spark: SparkSession, d: str) -> DataFrame:
    """Floor and ceiling, clamped; milliseconds round half to even."""
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(0), F.floor(v)).cast("long").alias("s"), F.least(F.lit(120), F.ceil(v * 1.5)).cast("long").alias("e"), F.bround(v * 1000, 0).cast("long").alias("ms"))


@query("WITH d AS (SELECT doc_id, n_chars % 20 AS n FROM documents), f AS (SELECT doc_id, n, unnest(range(0, n)) AS i FROM d) SELECT doc_id, i, least(i / 2.0, n / 2.0 - 0.25)::DOUBLE AS t FROM f")
def frame_timestamps(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).select("doc_id", (F.col("n_chars") % 20).alias("n")).where("n > 0")
    return x.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("doc_id", "i", F.least(F.col("i") / 2.0, F.col("n") / 2.0 - 0.25).cast("double").alias("t"))


@query("SELECT user_id, round(max(epoch(ts)) - min(epoch(ts)), 4) AS wall FROM events GROUP BY user_id")
def route_wall(spark: SparkSession, d: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, d, "events").groupBy("user_id").agg(F.round((F.max(micros) - F.min(micros)) / 1e6, 4).alias("wall"))


@query("WITH s AS (SELECT user_id, list(round(value) ORDER BY ts, event_id) AS v FROM events GROUP BY user_id), f AS (SELECT user_id, v, unnest(range(0, greatest(0, (len(v) - 8) // 4) + 1)) AS i FROM s) SELECT user_id, i AS frame, round(sqrt(list_aggregate(list_transform(list_slice(v, i * 4 + 1, i * 4 + 8), lambda x: x * x), 'sum') / 8), 6) AS rms FROM f")
def frame_signal(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping frames of eight samples, every four, padded with zeros; with RMS."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.round("value").alias("v")))), lambda x: x["v"]).alias("v"))
    n = F.greatest(F.lit(0), F.floor((F.size("v") - 8) / 4)).cast("long")
    f = s.select("user_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("frame"))
    part = F.slice("v", (F.col("frame") * 4 + 1).cast("int"), F.lit(8))
    return f.select("user_id", "frame", F.round(F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x) / 8), 6).alias("rms"))


@query("SELECT user_id, count(*) * 640 / 16000.0 AS seconds, count(*) * floor(448 / 28 * 448 / 28)::BIGINT AS visual_tokens, round(count(*) FILTER (WHERE value >= 20) / count(*), 6) AS active FROM events GROUP BY user_id")
def signal_activity(spark: SparkSession, d: str) -> DataFrame:
    """With samples_to_seconds and visual_token_estimate."""
    n = F.count("*")
    return table(spark, d, "events").groupBy("user_id").agg((n * 640 / 16000.0).cast("double").alias("seconds"), (n * 256).alias("visual_tokens"), F.round(F.count(F.when(F.col("value") >= 20, 1)) / n, 6).alias("active"))


@query(f"WITH d AS (SELECT item_id, list_distinct({TOK}) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM d a JOIN d b ON b.item_id = a.item_id + 1")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    j = x.select(F.col("item_id").alias("a"), "w").join(x.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("w").alias("v")), "a")
    return j.select("a", "b", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("WITH o AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, array_to_string(list(event_type ORDER BY f), ',') AS kinds FROM o GROUP BY user_id")
def ordered_unique(spark: SparkSession, d: str) -> DataFrame:
    """First occurrences in order."""
    k = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(k, ",").alias("kinds"))


@query(f"WITH {IV}, f AS (SELECT video_id, id, start_sec FROM iv WHERE start_sec >= 1704500000 AND start_sec < 1704900000) SELECT video_id, count(*) AS n, array_to_string(list(id || '@' || start_sec::BIGINT ORDER BY start_sec, id), ' ') AS frames FROM f GROUP BY video_id")
def package_micro_frames(spark: SparkSession, d: str) -> DataFrame:
    """Paths and times zipped, then filtered half-open."""
    g = intervals(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "id"))).alias("p"))
    z = F.arrays_zip(F.transform("p", lambda x: x["id"]).alias("path"), F.transform("p", lambda x: x["start_sec"]).alias("t"))
    kept = F.filter(z, lambda x: (x["t"] >= 1704500000) & (x["t"] < 1704900000))
    out = g.select("video_id", F.size(kept).cast("long").alias("n"), F.array_join(F.transform(kept, lambda x: F.concat(x["path"].cast("string"), F.lit("@"), x["t"].cast("long").cast("string"))), " ").alias("frames"))
    return out.where("n > 0")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS r, min(n) OVER (PARTITION BY user_id) AS lo, max(n) OVER (PARTITION BY user_id) AS hi FROM c) SELECT user_id, event_type, round(r, 6) AS ratio, CASE WHEN hi = lo THEN 1.0 ELSE round((n - lo) / (hi - lo), 6) END AS scaled FROM w")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    """As a map, scaled by its values; with normalize_score_map."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    v = F.map_values("m")
    lo, hi, s = F.array_min(v), F.array_max(v), F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    x = m.select("user_id", F.explode(F.transform_values("m", lambda k, n: F.struct(F.round(n / s, 6).alias("ratio"), F.when(hi == lo, 1.0).otherwise(F.round((n - lo) / (hi - lo), 6)).alias("scaled")))).alias("event_type", "y"))
    return x.select("user_id", "event_type", "y.ratio", "y.scaled")


_SPANS_OF = """(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"1": ' || (n_chars % 6) || ', "4-5": 2}' WHEN 1 THEN '{"' || (n_chars % 3 + 1) || '-' || (n_chars % 3 + 1 + n_chars % 5) || '": 4}' WHEN 2 THEN '{"1": 1, "' || (n_chars % 2 + 1) || '-' || (n_chars % 2 + 2) || '": 2}'
 WHEN 3 THEN lang || source ELSE '{"' || (n_chars % 9) || '": 2}' END AS s FROM documents)"""


@query(f"""WITH a AS {_SPANS_OF}, j AS (SELECT doc_id, json_valid(s) AS ok, CASE WHEN json_valid(s) THEN s END AS s FROM a), e AS (SELECT doc_id, unnest(json_keys(s)) AS k, s FROM j WHERE ok),
v AS (SELECT doc_id, CAST(split_part(k, '-', 1) AS BIGINT) AS lo, CAST(CASE WHEN contains(k, '-') THEN split_part(k, '-', 2) ELSE k END AS BIGINT) AS hi, CAST(json_extract(s, '$."' || k || '"') AS BIGINT) AS x FROM e), f AS (SELECT doc_id, unnest(range(lo, hi + 1)) AS f, x FROM v),
b AS (SELECT doc_id, max(CASE WHEN x NOT BETWEEN 1 AND 5 THEN 1 ELSE 0 END) AS bad_score, max(CASE WHEN f NOT BETWEEN 1 AND 6 THEN 1 ELSE 0 END) AS bad_range, CASE WHEN count(*) > count(DISTINCT f) THEN 1 ELSE 0 END AS overlap FROM f GROUP BY doc_id)
SELECT j.doc_id, CASE WHEN NOT ok THEN 'not_json' WHEN bad_score = 1 THEN 'score' WHEN bad_range = 1 THEN 'range' WHEN overlap = 1 THEN 'overlap' ELSE 'valid' END AS state FROM j LEFT JOIN b USING (doc_id)""")
def parse_span_scores(spark: SparkSession, d: str) -> DataFrame:
    """Keys n or a-b, scores 1 to 5, frames 1 to 6, no overlap."""
    n, k = F.col("n_chars"), F.col("doc_id") % 5
    t = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    s = (
        F.when(k == 0, t('{"1": ', n % 6, ', "4-5": 2}')).when(k == 1, t('{"', n % 3 + 1, "-", n % 3 + 1 + n % 5, '": 4}')).when(k == 2, t('{"1": 1, "', n % 2 + 1, "-", n % 2 + 2, '": 2}'))
        .when(k == 3, F.concat("lang", "source")).otherwise(t('{"', n % 9, '": 2}'))
    )
    x = _docs(spark, d).select("doc_id", F.from_json(s, "map<string,long>").alias("m"))
    ok = F.col("m").isNotNull() & (F.size("m") > 0)
    frames = F.flatten(F.transform(F.map_keys("m"), lambda k: F.sequence(F.split(k, "-")[0].cast("long"), F.element_at(F.split(k, "-"), -1).cast("long"))))
    state = (
        F.when(~ok, "not_json").when(F.exists(F.map_values("m"), lambda v: ~v.between(1, 5)), "score")
        .when(F.exists(frames, lambda f: ~f.between(1, 6)), "range").when(F.size(frames) > F.size(F.array_distinct(frames)), "overlap").otherwise("valid")
    )
    return x.select("doc_id", F.coalesce(state, F.lit("not_json")).alias("state"))


# -- hashes and lineage --------------------------------------------------------------


@query("SELECT doc_id, 'cand_' || left(sha1(concat_ws('|', doc_id, lang, source)), 12) AS id FROM documents")
def stable_id(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.lineage import stable_id as sid

    return _docs(spark, d).select("doc_id", sid("cand", "doc_id", "lang", "source").alias("id"))


@query("SELECT lang, doc_id // 1000 AS block, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS sha FROM documents GROUP BY 1, 2")
def ordered_identity_sha(spark: SparkSession, d: str) -> DataFrame:
    """The ids of a fixed population, a thousand numbers at most, in one hash."""
    from ..operators.lineage import ordered_sha

    return _docs(spark, d).groupBy("lang", F.expr("doc_id div 1000").alias("block")).agg(ordered_sha("doc_id").alias("sha"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS sha FROM documents")
def canonical_json_sha(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.lineage import canonical_sha

    return _docs(spark, d).select("doc_id", canonical_sha("source", "doc_id", "lang").alias("sha"))


@query("SELECT doc_id, sha256(concat_ws('|', lang, octet_length(encode(text)), sha256(text))) AS fp FROM documents")
def request_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Large values enter by length and hash; see run_fingerprint."""
    t = F.col("text").cast("binary")
    return _docs(spark, d).select("doc_id", F.sha2(F.concat_ws("|", "lang", F.octet_length(t).cast("string"), F.sha2(t, 256)).cast("binary"), 256).alias("fp"))


_TREE = "r AS (SELECT source AS path, doc_id, n_chars, sha256(coalesce(text, '')) AS h FROM documents), b1 AS (SELECT path, doc_id // 1000 AS k, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM r GROUP BY 1, 2), b2 AS (SELECT path, k // 1000 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM b1 GROUP BY 1, 2), t AS (SELECT path, sha256(string_agg(h, '' ORDER BY k)) AS sha FROM b2 GROUP BY 1)"


@query(f"WITH {_TREE}, f AS (SELECT path, sum(n_chars)::BIGINT AS bytes, any_value(sha) AS sha FROM r JOIN t USING (path) GROUP BY path) SELECT count(*) AS files, sum(bytes)::BIGINT AS bytes, sha256(string_agg(path || ' ' || bytes || ' ' || sha, chr(10) ORDER BY path)) AS aggregate FROM f")
def freeze_tree(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of path, size and hash, and the hash of the manifest. A source's rows are hashed by a tree of blocks of a thousand."""
    from ..operators.lineage import aggregate_manifest, tree_sha

    x = _docs(spark, d).withColumnRenamed("source", "path")
    sizes = x.groupBy("path").agg(F.sum("n_chars").alias("bytes"))
    return aggregate_manifest(sizes.join(tree_sha(x, "path", "doc_id", "text"), "path"))


@query(f"SELECT sha256(array_to_string({TOK}, ' ') || '|' || (item_id % 3)) AS claim, min(item_id) AS first_id, count(*) AS n FROM (SELECT * FROM benchmark UNION ALL SELECT * FROM benchmark WHERE item_id % 2 = 0) GROUP BY 1")
def claim_cache_dedup(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    u = b.unionByName(b.where("item_id % 2 = 0"))
    key = F.sha2(F.concat(F.array_join(T.tokens(F.col("text")), " "), F.lit("|"), (F.col("item_id") % 3).cast("string")).cast("binary"), 256)
    return u.groupBy(key.alias("claim")).agg(F.min("item_id").alias("first_id"), F.count("*").alias("n"))


@query(f"WITH {IV}, a AS (SELECT * FROM iv WHERE modality = 'view'), b AS (SELECT * FROM iv WHERE modality = 'click'), j AS (SELECT a.id, b.id % 7 AS word, min(b.start_sec) AS f FROM a JOIN b ON a.video_id = b.video_id AND a.start_sec < b.end_sec AND a.end_sec > b.start_sec GROUP BY 1, 2) SELECT id, array_to_string(list('w' || word ORDER BY f, word), ' ') AS captions FROM j GROUP BY id")
def union_of_captions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts of the overlapping segments in the order of time."""
    from ..operators.intervals import interval_join

    iv = intervals(spark, d)
    j = interval_join(iv.where("modality = 'view'"), iv.where("modality = 'click'"), ["video_id"], 21600.0)
    w = j.groupBy("id", (F.col("id_r") % 7).alias("word")).agg(F.min("start_sec_r").alias("f"))
    return w.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "word"))), lambda x: F.concat(F.lit("w"), x["word"].cast("string"))), " ").alias("captions"))
