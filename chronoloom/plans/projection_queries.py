"""Queries of readings put on one another: marks by certain places, spans of columns, surfaces on timed tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import projection, punctuation
from chronoloom.plans.registry import query, table

_L, _M = r"[^\p{P}\p{Z}\s]", r"[\p{P}\p{Z}\s]"


@query(
    rf"""WITH r AS (SELECT conv_id, turn, 1 AS candidate, text AS reading FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id, turn, 2, replace(text, ',', ';') FROM conversations WHERE text IS NOT NULL),
    t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN regexp_replace(text, '[.,]', '', 'g') ELSE replace(regexp_replace(text, '[.,]', '', 'g'), 'on', 'oon') END AS text FROM conversations WHERE text IS NOT NULL),
    c AS (SELECT conv_id, turn, text, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM t WHERE text <> ''),
    n AS (SELECT *, NOT regexp_matches(ch, '{_M}') AS lex, sum(CASE WHEN regexp_matches(ch, '{_M}') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM c),
    rc AS (SELECT conv_id, turn, candidate, unnest(string_split(reading, '')) AS ch, generate_subscripts(string_split(reading, ''), 1) AS pos FROM r WHERE reading <> ''),
    rn AS (SELECT *, sum(CASE WHEN regexp_matches(ch, '{_M}') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn, candidate ORDER BY pos) AS n FROM rc),
    b AS (SELECT conv_id, turn, candidate, n::BIGINT AS pl, string_agg(ch, '' ORDER BY pos) AS mark FROM rn WHERE regexp_matches(ch, '\p{{P}}') GROUP BY ALL),
    s AS (SELECT r.conv_id, r.turn, r.candidate, reading, regexp_replace(reading, '{_M}', '', 'g') AS s, regexp_replace(t.text, '{_M}', '', 'g') AS t FROM r JOIN t USING (conv_id, turn)),
    o AS (SELECT *, CASE WHEN turn % 5 = 0 OR length(t) <= 60 THEN length(t) = 0 ELSE TRUE END AS mixed FROM s),
    e AS (SELECT conv_id, turn, reading, (SELECT count(*) FROM b WHERE b.conv_id = o.conv_id AND b.turn = o.turn AND b.candidate = 1) AS n FROM o WHERE NOT mixed AND candidate = 1 AND s = t),
    a AS (SELECT b.*, s, t, mixed, s[greatest(pl - 3, 1):pl] AS l, s[greatest(pl - 3, 1):pl] || s[pl + 1:pl + 4] AS a FROM b JOIN o USING (conv_id, turn, candidate)),
    f AS (SELECT *, instr(t, a) - 1 AS found, CASE WHEN s = t THEN pl WHEN length(a) >= 4 AND length(s) - length(replace(s, a, '')) = length(a) AND length(t) - length(replace(t, a, '')) = length(a)
        AND (pl > 0 OR instr(t, a) = 1) AND (pl < length(s) OR instr(t, a) - 1 + length(a) = length(t)) THEN instr(t, a) - 1 + length(l) END AS place FROM a),
    k AS (SELECT * FROM f WHERE place IS NOT NULL AND length(t) > 0 AND list_bool_and([CASE WHEN mixed AND (x - 1) % 50 >= 45 THEN 2 ELSE 1 END = candidate for x in range(greatest(place, 1), least(length(t), place + 1) + 1)])),
    m AS (SELECT conv_id, turn, place, arg_min(mark, {{'c': candidate, 'a': pl}}) AS mark FROM k GROUP BY ALL),
    p AS (SELECT n.*, CASE WHEN lex AND NOT EXISTS (SELECT 1 FROM n x WHERE x.conv_id = n.conv_id AND x.turn = n.turn AND x.n = n.n AND regexp_matches(x.ch, '\p{{P}}')) THEN m.mark END AS mark FROM n LEFT JOIN m ON n.conv_id = m.conv_id AND n.turn = m.turn AND n.n = m.place AND n.lex),
    h AS (SELECT conv_id, turn, mark FROM m WHERE place = 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = m.conv_id AND n.turn = m.turn AND n.n = 0 AND regexp_matches(n.ch, '\p{{P}}'))),
    w AS (SELECT conv_id, turn, string_agg(ch || coalesce(mark, ''), '' ORDER BY pos) AS text FROM p GROUP BY conv_id, turn)
    SELECT t.conv_id, t.turn, md5(coalesce(e.reading, coalesce(h.mark, '') || w.text, t.text)) AS restored, coalesce(e.n, (SELECT count(*) FROM k WHERE k.conv_id = t.conv_id AND k.turn = t.turn)) AS boundaries
    FROM t LEFT JOIN e USING (conv_id, turn) LEFT JOIN h USING (conv_id, turn) LEFT JOIN w USING (conv_id, turn)"""
)
def native_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without stops and commas, most with changed words, get them back from two readings; in long ones some letters are the second reading's."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    bare = F.regexp_replace("text", "[.,]", "")
    changed = turns.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, bare).otherwise(F.replace(bare, F.lit("on"), F.lit("oon"))).alias("text"))
    size = F.length(projection.letters(F.col("text")))
    mixed = ~((F.col("turn") % 5 == 0) | (size <= 60))
    shared = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i % 50 >= 45, 2).otherwise(1))  # nothing of the text in the lambda, which runs once a letter
    texts = changed.withColumn("owners", F.when(mixed, shared).otherwise(F.array_repeat(F.lit(1), size)))
    readings = turns.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit(1).alias("candidate"), F.col("text").alias("reading")), F.struct(F.lit(2).alias("candidate"), F.replace("text", F.lit(","), F.lit(";")).alias("reading")))).alias("r"))
    told = projection.native_marks(texts, readings.select("conv_id", "turn", "r.candidate", F.col("r.candidate").alias("rank"), "r.reading"), ["conv_id", "turn"])
    return told.select("conv_id", "turn", F.md5("restored").alias("restored"), F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + x["boundaries"]).alias("boundaries"))


@query(
    """WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) AS words, turn * 4000 % 7919 AS shift FROM conversations),
    c AS (SELECT conv_id, turn, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS k, sum(words) OVER (PARTITION BY conv_id) * 300 + 50 AS "end", CASE WHEN words > 3 THEN sum(words) OVER (w ROWS UNBOUNDED PRECEDING) * 300 - shift END AS desired FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    d AS (SELECT *, greatest(i, least(coalesce(desired, "end" * (i + 1) // (k + 1)), "end" - (k - i))) - i AS ahead FROM c), e AS (SELECT *, max(ahead) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + i AS centre FROM d),
    f AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE least(floor((lag(centre) OVER (PARTITION BY conv_id ORDER BY turn) + centre) / 2)::BIGINT, "end" - (k - i)) END - i AS bound FROM e), g AS (SELECT *, max(bound) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + i AS s FROM f)
    SELECT conv_id, turn, CASE WHEN "end" >= k THEN s END::BIGINT AS column_start, CASE WHEN "end" >= k THEN coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY turn), "end") END::BIGINT AS column_end FROM g"""
)
def column_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as columns of their conversation's time, 300 a word; each desires the place where its words end, moved back by up to some thousand."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ ]+"), F.lit(0))).cast("long").alias("words"))
    summed = projection.neighbours.with_running_sum(turns, ["conv_id"], ["turn"], "words", F.floor(F.col("turn") / 1000))
    total = turns.groupBy("conv_id").agg((F.sum("words") * 300 + 50).alias("end"))
    columns = summed.join(total, "conv_id").select("conv_id", "turn", F.lit(0).cast("long").alias("start"), "end", F.when(F.col("words") > 3, F.col("upto") * 300 - F.col("turn") * 4000 % 7919).alias("desired"))
    return projection.column_spans(columns, ["conv_id"], "turn", "desired").select("conv_id", "turn", "column_start", "column_end")


@query(
    rf"""WITH t AS (SELECT conv_id, turn, text, turn % 2 = 0 AS en, [CASE WHEN i % 4 = 0 THEN w[i] || '.' WHEN turn % 7 = 6 AND i = 1 THEN w[i] || 'x' ELSE w[i] END for i in range(1, len(w) + 1)] AS w FROM (SELECT *, regexp_extract_all(text, '{_L}+') AS w FROM conversations WHERE text IS NOT NULL)),
    u AS (SELECT *, [length(regexp_replace(x, '{_M}', '', 'g')) for x in w] AS n, regexp_extract_all(text, '{_L}{_M}*') AS u, regexp_replace(array_to_string(w, ''), '{_M}', '', 'g') = regexp_replace(text, '{_M}', '', 'g') AND len(w) > 0 AS fits FROM t),
    p AS (SELECT conv_id, turn, en, i, turn * 100000 + 1000 * i AS s, CASE WHEN fits THEN CASE WHEN i = 1 THEN regexp_extract(text, '^{_M}*') ELSE '' END || array_to_string(u[list_sum(n[1:i]) - n[i] + 1 : list_sum(n[1:i])], '') ELSE w[i] END AS x FROM u, unnest(range(1, len(w) + 1)) q(i)),
    g AS (SELECT *, CASE WHEN en THEN regexp_extract_all(x, '[^\s]+\s*') ELSE string_split(x, '') END AS parts FROM p WHERE x <> ''),
    h AS (SELECT *, CASE WHEN CASE WHEN en THEN len(parts) > 1 ELSE length(regexp_replace(x, '{_M}', '', 'g')) > 18 END AND len(parts) <= 900 THEN parts ELSE [x] END AS q FROM g)
    SELECT conv_id, turn, count(*) AS tokens, md5(string_agg(x.t || '|' || x.s || '|' || x.e, ';' ORDER BY x.s, x.e, x.t)) AS digest FROM (SELECT conv_id, turn, unnest([{{'t': q[j], 's': s + 900 * (j - 1) // len(q), 'e': s + 900 * j // len(q)}} for j in range(1, len(q) + 1)]) AS x FROM h) GROUP BY conv_id, turn"""
)
def surfaced_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's words as timed tokens take its marks and blanks; long ones are cut. Every fourth has a stop of its own, and in every seventh turn a letter differs."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text")
    words = F.regexp_extract_all("text", F.lit(f"{projection.LETTER}+"), F.lit(0))
    own = lambda w, i: F.when(i % 4 == 3, F.concat(w, F.lit("."))).when((F.col("turn") % 7 == 6) & (i == 0), F.concat(w, F.lit("x"))).otherwise(w)
    begin = lambda i: F.col("turn") * 100_000 + 1000 * (i + 1).cast("long")
    timed = F.transform(words, lambda w, i: F.struct(own(w, i).alias("text"), begin(i).alias("start"), (begin(i) + 900).alias("end")))
    told = turns.withColumn("tokens", timed).withColumn("tokens", projection.surfaced(F.col("tokens"), F.col("text")))
    cut = told.withColumn("tokens", projection.subdivided(F.col("tokens"), F.when(F.col("turn") % 2 == 0, "en").otherwise("zh"))).filter(F.size("tokens") > 0)
    line = F.array_join(F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(t["start"], t["end"], t["text"]))), lambda t: F.concat_ws("|", t["text"], t["start"].cast("string"), t["end"].cast("string"))), ";")
    return cut.select("conv_id", "turn", F.size("tokens").cast("long").alias("tokens"), F.md5(line).alias("digest"))


def punctuation_cases(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text, proposal, spoken, labels): a turn as one line without some marks, with wide ones in its proposal, and boundaries after every so many letters."""
    line = F.regexp_replace(F.col("text"), r"[\r\n]", " ")
    bare = F.when(F.col("turn") % 3 == 0, F.translate(line, ",.", "，。")).otherwise(F.regexp_replace(line, r"\p{P}", ""))
    proposal = F.when(F.col("turn") % 4 > 0, F.translate(F.when(F.col("turn") % 4 == 3, F.regexp_replace(line, "e", "")).otherwise(line), ",.!?", "、。！？"))
    n = F.length(projection.letters(line))
    every = lambda k: F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i % k == 0) & (i <= n))
    spoken = F.when(F.col("turn") % 5 > 2, F.transform(every(23), lambda i: F.struct(i.alias("after"), (i * 37 % 900).cast("double").alias("pause"), (i % 46 == 0).alias("changed"), (i % 69 == 0).alias("rising"))))
    labels = F.transform(every(19), lambda i: F.struct(i.alias("after"), F.when(i % 2 == 0, "、").otherwise("」").alias("mark"), (i % 10 / 10).alias("confidence")))
    return turns.select("conv_id", "turn", bare.alias("text"), proposal.alias("proposal"), spoken.alias("spoken"), labels.alias("labels"))


@query()
def language_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns punctuated as Chinese and as Japanese from proposals, pauses and labels."""
    cases = punctuation_cases(table(spark, sf_dir, "conversations"))
    told = cases.select("conv_id", "turn", punctuation.chinese(F.col("text"), F.col("proposal"), F.col("spoken")).alias("zh"), punctuation.japanese(F.col("text"), F.col("proposal"), F.col("spoken"), F.col("labels")).alias("ja"))
    return told.select("conv_id", "turn", F.col("zh.text").alias("chinese"), F.col("zh.source").alias("chinese_source"), F.col("ja.text").alias("japanese"), F.col("ja.source").alias("japanese_source"))
