"""Queries of composed measures and of transcript, audio and face operators, beside their DuckDB SQL.

Conversations are read as transcripts: word i of a turn lasts 0.4 s from
100 * turn + i / 2.  Embeddings are read as 21 landmarks of a frame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import intervals as I
from ..operators import series as S
from ..operators import stats as A
from ..operators.stats import rounded as r
from ..sources import transcripts
from . import catalogue as C
from . import location, motion, speech
from .catalogue import _TOK, _WRITTEN, R, _mattr_sql, query, table

# -- transcripts ------------------------------------------------------------


def conversation_words(spark, sf_dir):
    """The words of the conversations as nested documents of one dialect, read back."""
    return transcripts.read_words(whisper_documents(spark, sf_dir))


def whisper_documents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    start = lambda i: F.col("turn") * 100 + i * 0.5
    word = lambda w, i: F.struct(w.alias("word"), start(i).alias("start"), (start(i) + 0.4).alias("end"), F.lit(0.9).alias("score"))
    seg = c.select("conv_id", "turn", F.struct(F.col("text").alias("text"), F.col("role").alias("speaker"), F.transform(T.tokens(F.col("text")), word).alias("words")).alias("s"))
    docs = seg.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s"))).alias("x"))
    return docs.select(F.col("conv_id").cast("string").alias("recording_id"), F.to_json(F.struct(F.transform("x", lambda y: y["s"]).alias("segments"))).alias("json"))


TR = f"""tw AS (SELECT conv_id, turn, role, unnest({_TOK}) word, generate_subscripts({_TOK}, 1) - 1 i FROM conversations),
 tt AS (SELECT CAST(conv_id AS VARCHAR) recording_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 old_idx, word, role speaker, turn * 100 + i * 0.5e0 s, turn * 100 + i * 0.5e0 + 0.4e0 e FROM tw),
 tl AS (SELECT *, s - lag(e) OVER o pause, CASE WHEN lag(speaker) OVER o IS DISTINCT FROM speaker THEN 1 ELSE 0 END fresh FROM tt WINDOW o AS (PARTITION BY recording_id ORDER BY old_idx)),
 ti AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY recording_id ORDER BY old_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) turn_id FROM tl),
 tj AS (SELECT *, row_number() OVER (PARTITION BY recording_id, turn_id ORDER BY old_idx) k FROM ti),
 tg AS (SELECT recording_id, turn_id, any_value(speaker) speaker, min(old_idx) utt_start, max(old_idx) utt_end, min(s) s, max(e) e, count(*) n, max(pause) FILTER (k = 1) pre, sum(pause) FILTER (k > 1) total,
  avg(pause) FILTER (k > 1) mean, var_pop(pause) FILTER (k > 1) pv, list(word ORDER BY old_idx) w FROM tj GROUP BY 1, 2),
 tk AS (SELECT *, (e - s) / 60 mins FROM tg WHERE speaker = 'user' AND n >= 3)"""


def _once_sql(w):
    return f"len(list_filter(list_distinct({w}), lambda x: len(list_filter({w}, lambda y: y = x)) = 1))"


_TURN_SQL = ", ".join([
    f"{R('CASE WHEN pre <= 0 THEN 0e0 ELSE pre END', 4)} pre_turn_pause", f"{R('mins', 6)} turn_length_minutes", "CAST(n AS INT) turn_length_words", f"{R('CASE WHEN mins > 0 THEN n / mins END', 4)} words_per_min",
    f"{R('CASE WHEN mins > 0 THEN 100 * (1 - coalesce(total, 0) / (60 * mins)) END', 4)} speech_percentage", f"{R('mean', 5)} mean_pause_length", f"{R('pv', 5)} pause_variability",
    *[f"{R(_mattr_sql('w', k), 6)} mattr_{k}" for k in speech.WINDOWS],
    f"{R(f'CASE WHEN n >= 10 AND {_once_sql("w")} < len(list_distinct(w)) THEN 100 * ln(CAST(n AS DOUBLE)) / (1 - {_once_sql("w")} / CAST(len(list_distinct(w)) AS DOUBLE)) END', 4)} honore_statistic",
    f"{R('CASE WHEN n >= 10 THEN pow(n, pow(len(list_distinct(w)), -0.172e0)) END', 5)} brunet_index", f"{R(f'100 * (1 - {_mattr_sql("w", 10)})', 4)} word_repeat_percentage", "coalesce(pre <= 0, false) interrupt_flag",
])
_TURN_DIGITS = {"pre_turn_pause": 4, "turn_length_minutes": 6, "words_per_min": 4, "speech_percentage": 4, "mean_pause_length": 5, "pause_variability": 5, **{f"mattr_{k}": 6 for k in speech.WINDOWS}, "honore_statistic": 4, "brunet_index": 5, "word_repeat_percentage": 4}


@query(f"WITH {TR} SELECT recording_id, turn_id, speaker, CAST(utt_start AS INT) utt_start, CAST(utt_end AS INT) utt_end, {_TURN_SQL} FROM tk")
def speech_turn_table(spark, sf_dir):
    t = speech.turn_table(speech.timed_words(conversation_words(spark, sf_dir)), "user", 3)
    return t.select("recording_id", "turn_id", "speaker", "utt_start", "utt_end", *[r(F.col(c), d).alias(c) for c, d in _TURN_DIGITS.items()], "turn_length_words", "interrupt_flag")


@query(f"""WITH {TR} SELECT tj.recording_id, CAST(old_idx AS INT) old_idx, tj.turn_id, word, {R('CASE WHEN NOT (tj.k = 1 AND tk.turn_id IS NOT NULL) THEN pause END', 4)} pre_word_pause
 FROM tj LEFT JOIN tk ON tj.recording_id = tk.recording_id AND tj.turn_id = tk.turn_id WHERE tj.speaker = 'user'""")
def speech_word_table(spark, sf_dir):
    w = speech.word_table(speech.timed_words(conversation_words(spark, sf_dir)), "user", 3)
    return w.select("recording_id", "old_idx", "turn_id", "word", r(F.col("pre_word_pause"), 4).alias("pre_word_pause"))


@query(f"""WITH {TR}, f AS (SELECT recording_id, max(e) / 60 file_length, 100 * sum(e - s) FILTER (speaker = 'user') / max(e) share FROM tg GROUP BY 1),
 a AS (SELECT recording_id, sum(mins) m, sum(n) n, count(*) t, count(*) FILTER (n = 1) t1, avg(mins) am, avg(n) an, avg(CASE WHEN pre <= 0 THEN 0e0 ELSE pre END) ap, count(*) FILTER (pre <= 0) ni, avg({_mattr_sql('w', 10)}) m10, avg(100 * (1 - {_mattr_sql('w', 10)})) wr FROM tk GROUP BY 1),
 p AS (SELECT tj.recording_id, CASE WHEN NOT (tj.k = 1 AND tk.turn_id IS NOT NULL) THEN pause END pause FROM tj LEFT JOIN tk ON tj.recording_id = tk.recording_id AND tj.turn_id = tk.turn_id WHERE tj.speaker = 'user'),
 w AS (SELECT recording_id, avg(pause) wp, var_samp(pause) wv FROM p GROUP BY 1)
 SELECT f.recording_id, {R('file_length', 5)} file_length, {R('share', 4)} speaker_percentage, {R('m', 5)} speech_length_minutes, CAST(n AS BIGINT) speech_length_words, t num_turns, t1 num_one_word_turns, {R('am', 6)} mean_turn_length_minutes, {R('an', 5)} mean_turn_length_words,
 {R('ap', 4)} mean_pre_turn_pause, ni num_interrupts, {R('m10', 6)} mattr_10, {R('wr', 4)} word_repeat_percentage, {R('wp', 4)} mean_pre_word_pause, {R('wv', 3)} mean_pause_variability, {R('CASE WHEN m > 0 THEN n / m END', 3)} words_per_min, {R('CASE WHEN m > 0 THEN 100 * m / file_length END', 4)} speech_percentage
 FROM f LEFT JOIN a ON f.recording_id = a.recording_id LEFT JOIN w ON f.recording_id = w.recording_id""")
def speech_summary_table(spark, sf_dir):
    s = speech.summary_table(speech.timed_words(conversation_words(spark, sf_dir)), "user", 3)
    digits = {"file_length": 5, "speaker_percentage": 4, "speech_length_minutes": 5, "mean_turn_length_minutes": 6, "mean_turn_length_words": 5, "mean_pre_turn_pause": 4, "mattr_10": 6, "word_repeat_percentage": 4, "mean_pre_word_pause": 4, "mean_pause_variability": 3, "words_per_min": 3, "speech_percentage": 4}
    return s.select("recording_id", *[r(F.col(c), d).alias(c) for c, d in digits.items()], "speech_length_words", "num_turns", "num_one_word_turns", "num_interrupts")


@query(f"WITH {TR} SELECT recording_id, CAST(old_idx AS INT) old_idx, word, {R('s', 3)} start_ms, {R('e', 3)} end_ms, speaker FROM tt")
def transcript_words(spark, sf_dir):
    """Words of nested documents: detection by shape, times, speakers, running index."""
    return conversation_words(spark, sf_dir).select("recording_id", "old_idx", "word", r(F.col("start"), 3).alias("start_ms"), r(F.col("end"), 3).alias("end_ms"), "speaker")


def _items(spark, sf_dir):
    """Events as transcripts of the item dialect: errors are punctuation without times."""
    e = C.words(spark, sf_dir)
    spoken = F.col("event_type") != "error"
    item = F.struct(F.when(spoken, "pronunciation").otherwise("punctuation").alias("type"), F.when(spoken, F.col("event_id").cast("string")).alias("start_time"), F.when(spoken, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).alias("end_time"),
                    F.concat(F.lit("spk_"), (F.col("event_id") % 2).cast("string")).alias("speaker_label"), F.array(F.struct(F.when(spoken, "0.9").otherwise("0.0").alias("confidence"), F.col("event_type").alias("content"))).alias("alternatives"))
    docs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("i")))).alias("x"))
    return docs.select(F.col("user_id").cast("string").alias("recording_id"), F.to_json(F.struct(F.lit("j").alias("jobName"), F.struct(F.transform("x", lambda y: y["i"]).alias("items")).alias("results"))).alias("json"))


@query("""WITH x AS (SELECT CAST(user_id AS VARCHAR) recording_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 old_idx, event_id, event_type FROM events)
 SELECT recording_id, CAST(old_idx AS INT) old_idx, event_type word, CAST(event_id * 1000 AS BIGINT) start_ms, 'speaker' || (event_id % 2) speaker FROM x WHERE event_type <> 'error'""")
def aws_words(spark, sf_dir):
    w = transcripts.read_words(_items(spark, sf_dir))
    return w.select("recording_id", "old_idx", "word", r(F.col("start"), 3).alias("start_ms"), T.speaker_label(F.col("speaker")).alias("speaker"))


def _lists(spark, sf_dir):
    e = C.words(spark, sf_dir)
    w = F.struct(F.col("event_type").alias("word"), F.col("event_id").cast("double").alias("start"), (F.col("event_id") + 0.5).alias("end"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("conf"))
    docs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", w.alias("w")))).alias("x"))
    return docs.select(F.col("user_id").cast("string").alias("recording_id"), F.to_json(F.transform("x", lambda y: y["w"])).alias("json"))


@query("""WITH x AS (SELECT CAST(user_id AS VARCHAR) recording_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 old_idx, event_id, event_type FROM events)
 SELECT recording_id, CAST(old_idx AS INT) old_idx, event_type word, CAST(event_id * 1000 + 500 AS BIGINT) end_ms, 'speaker0' speaker FROM x WHERE event_type <> 'error'""")
def vosk_words(spark, sf_dir):
    return transcripts.read_words(_lists(spark, sf_dir)).select("recording_id", "old_idx", "word", r(F.col("end"), 3).alias("end_ms"), "speaker")


@query("SELECT CAST(user_id AS VARCHAR) recording_id, count(*) n_words, string_agg(event_type, ' ' ORDER BY event_id) full_text, min(event_id) * 1000 start_ms FROM events GROUP BY 1")
def vosk_text(spark, sf_dir):
    """The whole list as one turn and text."""
    t = transcripts.vosk_turns(_lists(spark, sf_dir))
    return t.select("recording_id", F.size("words").cast("long").alias("n_words"), F.col("text").alias("full_text"), r(F.col("start"), 3).alias("start_ms"))


@query("SELECT CAST(conv_id AS VARCHAR) recording_id, string_agg(text, '' ORDER BY turn) full_text FROM conversations GROUP BY 1")
def whisper_text(spark, sf_dir):
    return transcripts.whisper_text(whisper_documents(spark, sf_dir)).select("recording_id", F.col("text").alias("full_text"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'participant' WHEN 'assistant' THEN 'clinician' ELSE role END AS label FROM conversations")
def label_substitution(spark, sf_dir):
    return transcripts.replaced_labels(table(spark, sf_dir, "conversations"), {"user": "participant", "assistant": "clinician"}, "role").select("conv_id", "turn", F.col("role").alias("label"))


@query("SELECT user_id, count(DISTINCT event_type) > 1 AS ambiguous FROM events GROUP BY 1")
def speaker_guard(spark, sf_dir):
    """Recordings that need a speaker label, since they have more than one."""
    return transcripts.speaker_counts(C.words(spark, sf_dir).withColumnRenamed("event_type", "speaker"), ["user_id"]).select("user_id", (F.col("speakers") > 1).alias("ambiguous"))


_SOUND = "CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'm' WHEN 'purchase' THEN 'o' END"


@query(f"""WITH x AS (SELECT *, {_SOUND} p, CAST(json_extract_string(props, '$.k') AS INT) / 50e0 d FROM events)
 SELECT event_id, 'S' || user_id || '_' || p || (row_number() OVER (PARTITION BY user_id, p ORDER BY event_id) - 1) AS name, CAST(event_id * 1000 AS BIGINT) start_ms FROM x WHERE p IS NOT NULL AND d > 0.7""")
def phonations(spark, sf_dir):
    word = F.when(F.col("event_type") == "click", "Uh,").when(F.col("event_type") == "view", "hmm").when(F.col("event_type") == "purchase", "OH!").otherwise("word")
    w = C.words(spark, sf_dir).select("user_id", "event_id", word.alias("word"), F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("speaker"), F.col("event_id").cast("double").alias("start"), (F.col("event_id") + F.col("k") / 50).alias("end"), (F.col("k") / 50).alias("d"))
    got = transcripts.phonations(w.where("d > 0.7").withColumn("end", F.col("start") + F.col("d") + 0.0001), ["user_id"], ["event_id"])
    return got.select("event_id", "name", r(F.col("start"), 3).alias("start_ms"))


@query("SELECT event_id, 'speaker' || (event_id % 12) AS speaker, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7, event_id % 7 + event_id % 5, event_id) AS place FROM events")
def diarization_rows(spark, sf_dir):
    e = C.words(spark, sf_dir)
    tracks = e.select("user_id", "event_id", F.concat(F.lit("SPEAKER_"), F.lpad((F.col("event_id") % 12).cast("string"), 2, "0")).alias("label"), (F.col("event_id") % 7).alias("start"), (F.col("event_id") % 7 + F.col("event_id") % 5).alias("end"))
    rows = transcripts.diarization_rows(tracks)
    return rows.withColumn("place", F.row_number().over(S.in_order(["user_id"], ["start_time", "end_time", "event_id"])).cast("long")).select("event_id", "speaker", "place")


@query("SELECT conv_id, turn, role || '-' || (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1) AS name, turn * 2000 AS start_ms FROM conversations")
def audio_ranges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1).alias("end"))
    return transcripts.numbered_ranges(c, ["conv_id"], ["turn"]).select("conv_id", "turn", "name", "start_ms")


@query(f"""SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '[^\\p{{L}}\\p{{N}} ''<>:]+', '', 'g'), ' +', ' ', 'g'))) AS strict FROM conversations""")
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strict_words(F.col("text")).alias("strict"))


@query("""WITH d AS (SELECT conv_id, string_agg('<spk:' || (CASE WHEN turn % 3 = 2 THEN 'x' ELSE CAST(turn % 3 + 1 AS VARCHAR) END) || '> ' || text, ' ' ORDER BY turn) t FROM conversations GROUP BY 1),
 w AS (SELECT conv_id, unnest(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) word, generate_subscripts(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> ''), 1) - 1 pos FROM d),
 s AS (SELECT *, last_value(CASE WHEN regexp_matches(word, '^<spk:([1-9]|10)>$') THEN regexp_extract(word, '^<spk:([0-9]+)>$', 1) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) k FROM w)
 SELECT conv_id, CAST(pos AS INT) AS place, word, coalesce(k, '1') AS speaker FROM s WHERE NOT starts_with(word, '<spk:')""")
def parsed_diarized(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    mark = F.when(F.col("turn") % 3 == 2, "x").otherwise((F.col("turn") % 3 + 1).cast("string"))
    part = F.concat(F.lit("<spk:"), mark, F.lit("> "), F.col("text"))
    d = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), " ").alias("t"))
    return S.diarized_words(d, ["conv_id"], "t").select("conv_id", F.col("at").alias("place"), "word", "speaker")


@query("SELECT doc_id, replace('Correct the labels: {text} END', '{text}', left(text, 40)) AS prompt FROM documents")
def prompt_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.prompt("Correct the labels: {text} END", F.left("text", F.lit(40))).alias("prompt"))


_SENT = "list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda p: len(list_filter(string_split_regex(p, '\\s+'), lambda w: w <> ''))), lambda n: n > 0)"


@query(f"""WITH d AS (SELECT conv_id, turn, {_SENT} n FROM conversations), p AS (SELECT conv_id, turn, unnest(n) k, generate_subscripts(n, 1) - 1 phrase FROM d),
 c AS (SELECT *, sum(k) OVER (PARTITION BY conv_id, turn ORDER BY phrase ROWS UNBOUNDED PRECEDING) last FROM p) SELECT conv_id, turn, CAST(phrase AS INT) phrase, CAST(last - k AS BIGINT) first_word, CAST(last - 1 AS BIGINT) last_word FROM c""")
def phrase_ranges(spark, sf_dir):
    """Index ranges of a turn's sentences, by their numbers of words."""
    return S.phrase_ranges(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text").select("conv_id", "turn", "phrase", "first_word", "last_word")


_TAGS = ["PRP", "VBD", "VBZ", "VB", "NN", "JJ", "RB", "DT", "IN", "PRP$"]


@query("""WITH t AS (SELECT event_id, (ARRAY['PRP', 'VBD', 'VBZ', 'VB', 'NN', 'JJ', 'RB', 'DT', 'IN', 'PRP$'])[CAST(event_id % 10 + 1 AS INT)] tag, CASE WHEN event_id % 3 = 0 THEN 'I' ELSE 'you' END word FROM events),
 c AS (SELECT *, CASE WHEN tag IN ('PRP', 'PRP$') THEN 'Pronoun' WHEN tag IN ('VB', 'VBD', 'VBZ') THEN 'Verb' WHEN tag = 'NN' THEN 'Noun' WHEN tag = 'JJ' THEN 'Adjective' WHEN tag = 'RB' THEN 'Adverb' WHEN tag = 'DT' THEN 'Determiner' ELSE 'Other' END pos FROM t)
 SELECT event_id, pos AS part_of_speech, CASE WHEN pos = 'Pronoun' THEN word = 'I' END AS first_person, CASE WHEN pos = 'Verb' THEN CASE tag WHEN 'VBZ' THEN 'Present' WHEN 'VBD' THEN 'Past' ELSE 'Other' END END AS verb_tense FROM c""")
def word_classes(spark, sf_dir):
    """Word classes, first person and tense from a tagger's tags."""
    tag, word = F.get(F.array(*map(F.lit, _TAGS)), (F.col("event_id") % 10).cast("int")), F.when(F.col("event_id") % 3 == 0, "I").otherwise("you")
    t = table(spark, sf_dir, "events").select("event_id", tag.alias("tag"), word.alias("word"))
    return t.select("event_id", T.word_class(F.col("tag")).alias("part_of_speech"), T.first_person(F.col("word"), F.col("tag")).alias("first_person"), T.tense(F.col("tag")).alias("verb_tense"))


_VAL = "CASE WHEN contains('lmnrw', c) THEN 3 WHEN contains('zvsf', c) THEN 2 WHEN contains('bcdgtkpqxhj', c) THEN 1 ELSE 4 END"


@query(f"""WITH d AS (SELECT DISTINCT unnest({_TOK}) word FROM conversations), c AS (SELECT word, unnest(string_split(word, '')) c, generate_subscripts(string_split(word, ''), 1) i, length(word) n FROM d),
 v AS (SELECT *, {_VAL} v, contains('aeiouy', c) vow FROM c), l AS (SELECT *, lag(v) OVER w p, lead(v) OVER w x, lag(vow) OVER w pv FROM v WINDOW w AS (PARTITION BY word ORDER BY i)),
 f AS (SELECT *, i > 1 AND i < n AND p >= v AND v = x flat, i > 1 AND i < n AND p > v AND v < x dip FROM l),
 g AS (SELECT *, sum(CASE WHEN dip AND NOT flat THEN 1 ELSE 0 END + CASE WHEN pf THEN 1 ELSE 0 END) OVER (PARTITION BY word ORDER BY i ROWS UNBOUNDED PRECEDING) seg FROM (SELECT *, coalesce(lag(flat) OVER (PARTITION BY word ORDER BY i), false) pf FROM f))
 SELECT word, CASE WHEN count(*) FILTER (vow) <= 1 THEN 1 ELSE CAST(count(DISTINCT seg) FILTER (vow) AS INT) END AS syllables FROM g GROUP BY 1""")
def syllable_count(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return w.select("word", T.syllables(F.col("word")).alias("syllables"))


# -- location -----------------------------------------------------------------

_ZONE = "Europe/Berlin"  # an hour ahead of UTC on all days of the events


def _trajectory(spark, sf_dir):
    w, e = S.in_order(C.BY, C.ORDER), I.spread(C.words(spark, sf_dir), C.BY)
    s = e.select("user_id", F.when(F.col("event_type").isin("click", "view"), 1).otherwise(2).alias("status"), F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), (F.col("value") / 1000).alias("lat0"), (F.col("k") / 1000).alias("lon0"),
                 F.lead(F.col("value") / 1000).over(w).alias("lat1"), F.lead(F.col("k") / 1000).over(w).alias("lon1"), (F.col("event_type") != "error").alias("observed"))
    return s.where("t1 > t0")


def _gps_sql(width):
    base = C._stats_sql(width).split(" sp AS")[0]
    home = f"""seg AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END status, event_type <> 'error' seen, t + 3600000000 t0, lead(t) {C.P} + 3600000000 t1, value / 1000 lat0, k / 1000 lon0, lead(value / 1000) {C.P} lat1, lead(k / 1000) {C.P} lon1 FROM w),
 cells AS (SELECT user_id, floor(lat0 / 0.01e0) a, floor(lon0 / 0.01e0) o, sum(t1 - t0) us FROM seg WHERE t1 > t0 AND status = 2 AND seen AND NOT (t0 // 3600000000 % 24 BETWEEN 8 AND 19) GROUP BY ALL),
 home AS (SELECT user_id, (a + 0.5e0) * 0.01e0 hlat, (o + 0.5e0) * 0.01e0 hlon FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, a, o) k FROM cells) WHERE k = 1),
 b AS (SELECT seg.*, unnest(range(t0 // {width}, (t1 - 1) // {width} + 1)) * {width} ws FROM seg WHERE t1 > t0),
 c AS (SELECT *, greatest(t0, ws) c0, least(t1, ws + {width}) c1 FROM b),"""
    rest = base[base.index("d AS (SELECT c.*"):].replace("FROM c JOIN home USING (user_id)", "FROM c LEFT JOIN home USING (user_id)")
    rest = rest[: rest.index(" g AS (")]
    g = f""" dk AS (SELECT *, NOT (((c0 + c1) / 2 / 3.6e9) % 24 >= 8 AND ((c0 + c1) / 2 / 3.6e9) % 24 < 20) dark FROM e),
 g AS (SELECT user_id, ws, sum(CASE WHEN seen THEN hrs ELSE 0 END) ob, sum(CASE WHEN seen AND NOT dark THEN hrs ELSE 0 END) od, sum(CASE WHEN seen AND dark THEN hrs ELSE 0 END) og, sum(CASE WHEN status = 1 THEN hrs ELSE 0 END) mo, sum(CASE WHEN status = 2 THEN hrs ELSE 0 END) pa,
  sum(round_even(metres, 0)) / 1000 di, sum(CASE WHEN (h0 + h1) / 2 <= 50 THEN hrs ELSE 0 END) ho, max(greatest(h0, h1)) / 1000 hx, (sum(h0) + sum(h1)) / (2 * count(*)) / 1000 hm FROM dk GROUP BY user_id, ws),
 sp AS (SELECT user_id, unnest(range(min(ws), max(ws) + 1, {width})) ws FROM g GROUP BY user_id),
 st AS (SELECT sp.user_id, strftime(make_timestamp(sp.ws), '{"%Y-%m-%d" if width == C.DAY else "%Y-%m-%d %H:00:00"}') datetime, ob, od, og, mo, pa, di, ho, hx, hm FROM sp LEFT JOIN g ON sp.user_id = g.user_id AND sp.ws = g.ws)"""
    return f"{C.W}, {home} {rest}{g}"


_GPS = [("ob", "observed_time", 5), ("mo", "move_time", 5), ("pa", "pause_time", 5), ("di", "dist_travelled", 2), ("ho", "home_time", 5), ("hx", "home_max_dist", 4), ("hm", "home_mean_dist", 4)]
_GPS_DAY = [_GPS[0], ("od", "observed_time_day", 5), ("og", "observed_time_night", 5), *_GPS[1:]]
#: Digits of the means over days: distances are sums of whole metres, which fall on ties with fewer.
_SUMMARY = {b: 4 if b == "dist_travelled" else 2 for _, b, _ in _GPS}
_cols = lambda cols: ", ".join(f"{R(a, d)} {b}" for a, b, d in cols)


@query(f"WITH {_gps_sql(C.HOUR)} SELECT user_id, datetime, {_cols(_GPS)} FROM st")
def gps_hourly_table(spark, sf_dir):
    return location.gps_analysis(_trajectory(spark, sf_dir), C.BY, _ZONE)[0].select("user_id", "datetime", *[r(F.col(b), d).alias(b) for _, b, d in _GPS])


@query(f"WITH {_gps_sql(C.DAY)} SELECT user_id, datetime, {_cols(_GPS_DAY)} FROM st")
def gps_daily_table(spark, sf_dir):
    return location.gps_analysis(_trajectory(spark, sf_dir), C.BY, _ZONE)[1].select("user_id", "datetime", *[r(F.col(b), d).alias(b) for _, b, d in _GPS_DAY])


@query(f"WITH {_gps_sql(C.DAY)} SELECT user_id, count(*) no_days, {R('CASE WHEN count(ob) = count(*) THEN sum(ob) END', 4)} total_observed_time, {', '.join(f'{R(f"avg({a})", _SUMMARY[b])} mean_{b}, {R(f"stddev_pop({a})", 2)} sd_{b}' for a, b, _ in _GPS[1:])} FROM st GROUP BY 1")
def gps_summary_table(spark, sf_dir):
    got = location.gps_analysis(_trajectory(spark, sf_dir), C.BY, _ZONE)[2]
    return got.select("user_id", "no_days", r(F.col("total_observed_time"), 4).alias("total_observed_time"), *[r(F.col(f"{m}_{b}"), _SUMMARY[b] if m == "mean" else 2).alias(f"{m}_{b}") for _, b, _ in _GPS[1:] for m in ("mean", "sd")])


@query(f"WITH {C.W}, l AS (SELECT *, lead(t) {C.P} t1, lead(value / 1000) {C.P} a1, lead(k / 1000) {C.P} o1 FROM w) SELECT user_id, event_id, CASE WHEN {C.GC('value / 1000', 'k / 1000', 'a1', 'o1')} > 5000 THEN 1 ELSE 2 END AS status FROM l WHERE t1 > t")
def stop_detection(spark, sf_dir):
    p = C.words(spark, sf_dir).select("user_id", "event_id", "t", (F.col("value") / 1000).alias("lat"), (F.col("k") / 1000).alias("lon"))
    return location.stops(p, C.BY, C.ORDER, 5000.0).select("user_id", "event_id", "status")


# -- faces, heads, eyes ---------------------------------------------------------

_LOWER = [1, 4, 4, 8]


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    point = lambda i: F.struct(F.get("v", i * 3).alias("x"), F.get("v", i * 3 + 1).alias("y"), F.get("v", i * 3 + 2).alias("z"))
    return e.select("label", "vec_id", F.transform(F.sequence(F.lit(0), F.lit(20)), point).alias("landmarks"))


_DIST = "list_transform(range(0, 21), lambda i: sqrt(pow(a.v[i * 3 + 1] - b.v[i * 3 + 1], 2) + pow(a.v[i * 3 + 2] - b.v[i * 3 + 2], 2) + pow(a.v[i * 3 + 3] - b.v[i * 3 + 3], 2)))"


@query(f"""WITH {C._E}, d AS (SELECT a.label, {_DIST} d FROM e a JOIN e b ON a.label = b.label AND b.n = a.n - 1), m AS (SELECT label, list_sum(d) / 21 o, (d[2] + d[5] + d[5] + d[9]) / 4 l, (list_sum(d) - d[2] - d[5] - d[9]) / 18 u FROM d)
 SELECT label, {', '.join(f'{R(f"avg({a}) / 3", 5)} {b}_mean, {R(f"stddev_samp({a}) / sqrt(3e0)", 5)} {b}_std' for a, b in (('o', 'overall'), ('l', 'lower_face'), ('u', 'upper_face')))} FROM m GROUP BY 1""")
def facial_summary(spark, sf_dir):
    cols = ["overall", "lower_face", "upper_face"]
    got = motion.facial_summary(motion.facial_displacement(_frames(spark, sf_dir), ["label"], "vec_id", {"lower_face": _LOWER}, 21), ["label"], cols, 2)
    return got.select("label", *[r(F.col(f"{c}_{m}"), 5).alias(f"{c}_{m}") for c in cols for m in ("mean", "std")])


@query(f"""WITH {C._E}, q AS (SELECT vec_id, v, sqrt(pow(v[13] - v[7], 2) + pow(v[14] - v[8], 2) + pow(v[15] - v[9], 2)) s, atan2(v[14] - v[8], v[13] - v[7]) t FROM e)
 SELECT vec_id, {R('((v[10] - v[1]) * cos(-t) - (v[11] - v[2]) * sin(-t)) / s', 5)} x3, {R('((v[10] - v[1]) * sin(-t) + (v[11] - v[2]) * cos(-t)) / s', 5)} y3, {R('(v[12] - v[3]) / s', 5)} z3 FROM q""")
def normalised_face(spark, sf_dir):
    p = V.normalised_face(F.col("landmarks"), 0, 2, 4, True)
    f = _frames(spark, sf_dir).select("vec_id", F.get(p, F.lit(3)).alias("p"))
    return f.select("vec_id", *[r(F.col(f"p.{c}"), 5).alias(f"{c}3") for c in "xyz"])


def _heads(spark, sf_dir):
    e = C.words(spark, sf_dir)
    known = F.when(F.col("event_type") != "error", F.col("value"))
    return e.select("user_id", "event_id", known.alias("bb_x1"), (known + F.col("k")).alias("bb_x2"), (known / 2).alias("bb_y1"), (known / 2 + 7).alias("bb_y2"), (F.col("k") - 50).alias("pitch"), (F.col("value") / 7).alias("yaw"), F.when(F.col("event_type") != "error", F.col("k") / 3).alias("roll"))


_HP = "OVER (PARTITION BY user_id ORDER BY event_id)"
_ANG = "degrees(acos(greatest(-1e0, least(1e0, (cos(radians(yaw)) * cos(radians(roll)) + cos(radians(pitch)) * cos(radians(roll)) - sin(radians(pitch)) * sin(radians(yaw)) * sin(radians(roll)) + cos(radians(pitch)) * cos(radians(yaw)) - 1) / 2))))"


@query(f"""WITH {C.W}, h AS (SELECT user_id, event_id, value + k / 2 x, value / 2 + 3.5 y, event_type <> 'error' seen, k - 50 pitch, value / 7 yaw, CASE WHEN event_type <> 'error' THEN k / 3 END roll FROM w),
 s AS (SELECT *, {_ANG} ang FROM h), f AS (SELECT user_id, event_id, coalesce(sqrt(pow(x - lag(x) {_HP}, 2) + pow(y - lag(y) {_HP}, 2)), 0) d, count(*) OVER (PARTITION BY user_id) n, abs(ang - lag(ang) {_HP}) a FROM s WHERE seen)
 SELECT s.user_id, {', '.join(f'{R(f"avg({x})", 3)} {c}_mean, {R(f"stddev_samp({x})", 3)} {c}_std' for c, x in (('xy_disp', 'CASE WHEN n > 1 THEN d END'), ('pitch', 'pitch'), ('yaw', 'yaw'), ('roll', 'roll'), ('euclidean_angle_disp', 'a')))}
 FROM s LEFT JOIN f ON s.user_id = f.user_id AND s.event_id = f.event_id GROUP BY 1""")
def head_summary(spark, sf_dir):
    got = motion.head_summary(motion.head_movement(_heads(spark, sf_dir), ["user_id"], "event_id"), ["user_id"], "event_id")
    return got.select("user_id", *[r(F.col(f"{c}_{m}"), 3).alias(f"{c}_{m}") for c in motion.HEAD for m in ("mean", "std")])


@query(f"WITH {C.W}, a AS (SELECT event_id, radians(k - 50) p, radians(value / 10) y, radians(k / 3) r FROM w) SELECT event_id, {R('degrees(acos(greatest(-1e0, least(1e0, (cos(y) * cos(r) + cos(p) * cos(r) + sin(p) * sin(y) * sin(r) + cos(p) * cos(y) - 1) / 2))))', 4)} zyx, {R('degrees(acos(greatest(-1e0, least(1e0, (cos(y) * cos(r) + cos(p) * cos(r) - sin(p) * sin(y) * sin(r) + cos(p) * cos(y) - 1) / 2))))', 4)} zxy FROM a")
def rotation_orders(spark, sf_dir):
    e = C.words(spark, sf_dir)
    return e.select("event_id", *[r(V.rotation_angle(F.col("k") - 50, F.col("value") / 10, F.col("k") / 3, o), 4).alias(o.lower()) for o in ("ZYX", "ZXY")])


@query(f"WITH {C.W}, n AS (SELECT user_id, event_id, event_type, value, row_number() {C.P} - 1 f FROM w), m AS (SELECT user_id, max(f) m FROM n GROUP BY 1), s AS (SELECT user_id, unnest(range(0, m + 3)) f FROM m) SELECT s.user_id, s.f AS frame, {R('value', 3)} value_e3 FROM s LEFT JOIN n ON s.user_id = n.user_id AND s.f = n.f AND n.event_type <> 'error' WHERE s.f < 40")
def undetected_frames(spark, sf_dir):
    n = C.words(spark, sf_dir).withColumn("frame", (F.row_number().over(S.in_order(C.BY, C.ORDER)) - 1).cast("long"))
    all_frames = n.groupBy("user_id").agg((F.max("frame") + 3).alias("n"))
    got = S.with_missing_frames(n.where("event_type <> 'error'"), ["user_id"], "frame", all_frames)
    return got.where("frame < 40").select("user_id", "frame", r(F.col("value"), 3).alias("value_e3"))


@query(f"WITH {C.W}, n AS (SELECT *, row_number() {C.P} f FROM w), p AS (SELECT user_id, f, k / 100 p FROM n WHERE k > 30) SELECT n.user_id, n.event_id, {R('p', 2)} probability FROM n LEFT JOIN p ON n.user_id = p.user_id AND n.f = p.f")
def speaking_join(spark, sf_dir):
    n = C.words(spark, sf_dir).withColumn("frame", F.row_number().over(S.in_order(C.BY, C.ORDER)))
    p = n.where("k > 30").select("user_id", "frame", (F.col("k") / 100).alias("probability"))
    return motion.with_probability(n, p, ["user_id"], "frame").select("user_id", "event_id", r(F.col("probability"), 2).alias("probability"))


@query(f"""WITH {C.W}, x AS (SELECT user_id, (event_id % 40) * 10 f FROM w GROUP BY ALL), l AS (SELECT *, CASE WHEN f - lag(f) OVER o <= 15 THEN 0 ELSE 1 END fresh FROM x WINDOW o AS (PARTITION BY user_id ORDER BY f)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY f ROWS UNBOUNDED PRECEDING) sid FROM l),
 k AS (SELECT user_id, sid, min(f) lo, max(f) hi FROM s GROUP BY 1, 2 HAVING count(*) * 10 > 25), u AS (SELECT user_id, unnest(range(lo, hi + 1)) f, hi, lo FROM k) SELECT user_id, f AS frame, f % 10 = 0 AS detected FROM u WHERE f < hi OR f % 10 = 0""")
def upsampled_presence(spark, sf_dir):
    x = C.words(spark, sf_dir).select("user_id", ((F.col("event_id") % 40) * 10).alias("frame")).distinct().withColumn("seen", F.lit(True))
    return S.presence_frames(x, ["user_id"], "frame", 10, 10, 25).select("user_id", "frame", F.coalesce("seen", F.lit(False)).alias("detected"))


@query(f"WITH {C.W}, a AS (SELECT user_id, event_id, row_number() {C.P} n FROM w), b AS (SELECT user_id, value, row_number() {C.P} n FROM w WHERE event_type = 'click') SELECT a.user_id, a.event_id, {R('b.value', 3)} value_e3 FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.n = b.n")
def positional_concat(spark, sf_dir):
    e = C.words(spark, sf_dir)
    got = S.beside(e.select("user_id", "t", "event_id"), e.where("event_type = 'click'").select("user_id", "t", "event_id", "value"), ["user_id"], ["t", "event_id"], ["value"])
    return got.select("user_id", "event_id", r(F.col("value"), 3).alias("value_e3"))


@query(f"""WITH {C.W}, l AS (SELECT user_id, CAST(event_id % 3 + 1 AS DOUBLE) d FROM w), c AS (SELECT user_id, d, count(*) n FROM l GROUP BY 1, 2), m AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, d) k FROM c) SELECT user_id, CAST(floor(1 / (d / 100)) AS INT) AS fps FROM m WHERE k = 1""")
def frame_rate(spark, sf_dir):
    """Frames a second from the commonest step; times are running sums of steps of 1 to 3 hundredths."""
    e = C.words(spark, sf_dir)
    steps = e.select("user_id", "event_id", (F.col("event_id") % 3 + 1).alias("d"))
    t = steps.withColumn("time", F.sum("d").over(S.in_order(["user_id"], ["event_id"])) / 100.0)
    first = steps.groupBy("user_id").agg(F.lit(-1).cast("long").alias("event_id")).withColumn("time", F.lit(0.0))
    return A.fps(t.select("user_id", "event_id", "time").unionByName(first), ["user_id"], "time")


@query("SELECT l_returnflag, count(*) n, CAST(ceil(count(*) / 7e0) AS BIGINT) sampled FROM lineitem GROUP BY 1")
def sampled_counts(spark, sf_dir):
    """Every seventh row of each recording in order: decimation."""
    i = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    n = i.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    kept = S.decimated(i, ["l_returnflag", "l_orderkey"], ["l_linenumber"], 1).groupBy("l_returnflag").agg(F.count("*").alias("m"))
    return n.join(kept, "l_returnflag").select("l_returnflag", "n", F.ceil(F.col("m") / 7.0).alias("sampled"))


@query(f"WITH {C.W}, n AS (SELECT user_id, event_id, row_number() {C.P} k FROM w) SELECT user_id, event_id FROM n WHERE k <= 5")
def frame_limit(spark, sf_dir):
    """The first five sampled frames of each recording: the limit is the feature."""
    return S.first_rows(C.words(spark, sf_dir), C.BY, C.ORDER, 5).select("user_id", "event_id")


@query(f"WITH {C.W} SELECT event_id, CAST(greatest(0, floor(value) - floor(k * 0.1e0)) AS BIGINT) x, CAST(k + 2 * floor(k * 0.1e0) AS BIGINT) w, {R('least(-20 - value / 10, -(-k / 10))', 3)} gain_e3 FROM w")
def boxes_and_gains(spark, sf_dir):
    box = V.padded_box(F.floor("value"), F.lit(0), F.col("k"), F.col("k"), 0.1)
    e = C.words(spark, sf_dir).select("event_id", box.alias("b"), r(V.loudness_gain(F.col("value") / 10, -F.col("k") / 10, -20.0), 3).alias("gain_e3"))
    return e.select("event_id", F.col("b.x").cast("long").alias("x"), F.col("b.w").cast("long").alias("w"), "gain_e3")


# -- voice ------------------------------------------------------------------------


@query(f"""WITH {C.W}, s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 2 + k / 100 a, count(*) OVER (PARTITION BY user_id) n FROM w), t AS (SELECT user_id, a, a + 0.6e0 b, (n * 2 + 3) * 100 frames FROM s),
 l AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY a), 0) f FROM t), k AS (SELECT * FROM l WHERE a - f > 0.1e0), r AS (SELECT user_id, unnest(range(CAST(ceil(f * 100) AS BIGINT), CAST(floor(a * 100) AS BIGINT))) fr FROM k),
 x AS (SELECT user_id, arg_max(b, a) e, any_value(frames) frames FROM k GROUP BY 1), z AS (SELECT user_id, unnest(range(CAST(floor(e * 100) AS BIGINT), CAST(frames AS BIGINT))) fr FROM x WHERE frames / 100e0 - e > 0.1e0),
 u AS (SELECT * FROM r UNION ALL SELECT * FROM z) SELECT user_id, count(*) n_frames, CAST(sum(fr) AS BIGINT) frame_sum FROM u GROUP BY 1""")
def speech_frames(spark, sf_dir):
    n = F.row_number().over(S.in_order(["user_id"], ["event_id"]))
    s = C.words(spark, sf_dir).select("user_id", (n * 2 + F.col("k") / 100).alias("a"))
    s = s.withColumn("b", F.col("a") + 0.6)
    rec = s.groupBy("user_id").agg(((F.count("*") * 2 + 3) * 100).alias("n_frames"))
    return S.speech_runs(s, rec, ["user_id"], "a", "b").groupBy("user_id").agg(F.count("*").alias("n_frames"), F.sum("frame_idx").alias("frame_sum"))


@query(f"""WITH {C.W}, p AS (SELECT user_id, k / 40 p FROM w), m AS (SELECT user_id, median(p) m, count(*) FILTER (p > 0.05e0 AND p < 2) / nullif(500 - sum(p), 0) spir FROM p GROUP BY 1)
 SELECT user_id, {R('any_value(spir)', 6)} spir_e6, {R('any_value(m)', 4)} dur_med, {R('median(abs(p - m))', 4)} dur_mad FROM p JOIN m USING (user_id) GROUP BY 1""")
def silence_summary(spark, sf_dir):
    got = A.silence_summary(C.words(spark, sf_dir).select("user_id", (F.col("k") / 40).alias("p")), ["user_id"], "p", F.lit(500.0))
    return got.select("user_id", r(F.col("spir"), 6).alias("spir_e6"), r(F.col("median"), 4).alias("dur_med"), r(F.col("mad"), 4).alias("dur_mad"))


@query(f"SELECT event_type, {R('avg(m)', 4)} f0_mean, {R('avg(x)', 4)} gne_ratio FROM (SELECT user_id, event_type, avg(nullif(value, 0)) m, max(nullif(value, -200)) x FROM events GROUP BY 1, 2) GROUP BY 1")
def voice_summary_means(spark, sf_dir):
    """Summaries of files and their means over the files of a list."""
    per = C.words(spark, sf_dir).groupBy("user_id", "event_type").agg(F.avg(F.nullif(F.col("value"), F.lit(0.0))).alias("f0_mean"), A.largest(F.col("value"), -200.0).alias("gne_ratio"))
    return A.mean_of_files(per, ["event_type"]).select("event_type", r(F.col("f0_mean"), 4).alias("f0_mean"), r(F.col("gne_ratio"), 4).alias("gne_ratio"))


_Q = "list_transform(range(1, 4), lambda i: {})"


@query(f"""WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) e FROM embeddings), m AS (SELECT label, median(e[2]) m FROM v GROUP BY 1)
 SELECT label, {', '.join(f'{R(f"avg(e[{i}])", 6)} mfcc{i}_mean, {R(f"var_pop(e[{i}])", 6)} mfcc{i}_var' for i in (1, 2, 14))}, {R('median(abs(e[2] - m))', 6)} spectral_variability FROM v JOIN m USING (label) GROUP BY 1""")
def cepstral_moments(spark, sf_dir):
    v = C._vectors(spark, sf_dir)
    got = A.cepstral_moments(v, ["label"], "v", 14)
    return got.select("label", *[r(F.col(f"mfcc{i}_{m}"), 6).alias(f"mfcc{i}_{m}") for i in (1, 2, 14) for m in ("mean", "var")], r(F.col("spectral_variability"), 6).alias("spectral_variability"))


@query(f"""WITH {C._E}, t AS (SELECT a.label, a.n, a.vec_id % 4 + 2 AS words, {C._COS('a.v', 'b.v')} s, b.vec_id % 4 + 2 AS before FROM e a LEFT JOIN e b ON a.label = b.label AND b.n = a.n - 1)
 SELECT label, n AS turn, {R('CASE WHEN words >= 3 AND before >= 3 THEN s END', 6)} turn_to_turn_tangeniality FROM t""")
def turn_tangentiality(spark, sf_dir):
    v = C._vectors(spark, sf_dir).withColumns({"turn": F.row_number().over(S.in_order(["label"], ["vec_id"])).cast("long"), "n_words": F.col("vec_id") % 4 + 2})
    return S.with_turn_tangentiality(v, ["label"], ["vec_id"], "v", "n_words", 3).select("label", "turn", r(F.col("turn_to_turn"), 6).alias("turn_to_turn_tangeniality"))


_WC = ["coherence", "coherence_5", "coherence_10", *[f"variability_{k}" for k in range(2, 11)]]


@query(f"""WITH {C._E}, p AS (SELECT a.vec_id, a.label, a.c, b.n - a.n k, {C._COS('a.v', 'b.v')} s FROM e a JOIN e b ON a.label = b.label AND b.n - a.n BETWEEN -10 AND 10),
 w AS (SELECT label, vec_id, max(s) FILTER (k = -1) coherence, CASE WHEN any_value(c) > 5 AND count(*) FILTER (abs(k) <= 2) = 5 THEN avg(s) FILTER (abs(k) <= 2) END coherence_5, CASE WHEN any_value(c) > 10 AND count(*) FILTER (abs(k) <= 5) = 11 THEN avg(s) FILTER (abs(k) <= 5) END coherence_10, {', '.join(f'max(s) FILTER (k = {k}) variability_{k}' for k in range(2, 11))} FROM p GROUP BY 1, 2)
 SELECT label, {', '.join(f'{R(f"avg({c})", 6)} {c}_mean, {R(f"var_samp({c})", 6)} {c}_var' for c in _WC)} FROM w GROUP BY 1""")
def word_coherence_summary(spark, sf_dir):
    b = S.with_coherence(C._vectors(spark, sf_dir), ["label"], ["vec_id"], "v")
    return b.groupBy("label").agg(*[a for c in _WC for a in (r(F.avg(c), 6).alias(f"{c}_mean"), r(F.var_samp(c), 6).alias(f"{c}_var"))])


@query(f"""WITH {C.W}, t AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN k END p, value / 500 pos, k / 200 neg FROM w), s AS (SELECT user_id, (100 - p) * pos a, p * neg b, pos > neg m FROM t)
 SELECT user_id, {R('avg(a)', 3)} positive, {R('avg(b)', 3)} negative, {R('avg(CASE WHEN m THEN a ELSE b END)', 3)} overall FROM s GROUP BY 1""")
def first_person_sentiment(spark, sf_dir):
    t = A.in_sequence(C.words(spark, sf_dir), C.BY, C.ORDER).select("user_id", F.when(F.col("event_type") != "error", F.col("k")).alias("share"), (F.col("value") / 500).alias("pos"), (F.col("k") / 200).alias("neg"))
    return A.first_person_sentiment(t, ["user_id"], "share", "pos", "neg").select("user_id", *[r(F.col(c), 3).alias(c) for c in ("positive", "negative", "overall")])


@query(f"WITH {C._E}, s AS (SELECT label, vec_id % 2 AS speaker, avg(v[1]) score FROM e GROUP BY 1, 2), m AS (SELECT label, arg_max(speaker, score) best FROM s GROUP BY 1) SELECT label, CAST(best AS BIGINT) AS clinician FROM m")
def clinician_label(spark, sf_dir):
    v = C._vectors(spark, sf_dir).select("label", (F.col("vec_id") % 2).alias("speaker"), F.get("v", F.lit(0)).alias("s"))
    scores = v.groupBy("label", "speaker").agg(F.avg("s").alias("score"))
    return A.labelled_speakers(scores, ["label"], "speaker", "score").select("label", F.col("clinician").cast("long").alias("clinician"))


def _voice(spark, sf_dir):
    """Events as frames, and two silences of each recording: the stretch between them is too short to be speech."""
    f = C.words(spark, sf_dir).select("user_id", (F.row_number().over(S.in_order(C.BY, C.ORDER)) - 1).cast("long").alias("frame_idx"), F.when(F.col("event_type") != "error", F.col("value")).otherwise(0.0).alias("f0"), F.col("k").alias("loudness"))
    pause = F.explode(F.array(*[F.struct(F.lit(a).alias("pause_start"), F.lit(b).alias("pause_end"), F.lit(d).alias("pause_duration")) for a, b, d in ((0.2, 0.45, 0.25), (0.5, 0.52, 0.02))]))
    return f, f.select("user_id").distinct().select("user_id", pause.alias("p")).select("user_id", "p.*")


@query(f"""WITH {C.W}, f AS (SELECT user_id, row_number() {C.P} - 1 f, count(*) OVER (PARTITION BY user_id) n, CASE WHEN event_type <> 'error' THEN value ELSE 0 END f0, k FROM w),
 v AS (SELECT * FROM f WHERE f < 20 OR (n / 100e0 - 0.45e0 > 0.1e0 AND f >= 45)), m AS (SELECT user_id, avg(f0) a, stddev_pop(f0) s FROM v GROUP BY 1),
 x AS (SELECT user_id, {R('avg(nullif(f0, 0))', 3)} f0_mean, {R('stddev_samp(nullif(f0, 0))', 3)} f0_stddev, {R('max(nullif(f0, 0)) - min(nullif(f0, 0))', 2)} f0_range, {R('any_value(s) / nullif(any_value(a), 0)', 5)} rel_f0_sd, {R('stddev_pop(k) / nullif(avg(k), 0)', 5)} rel_se0_sd, {R('kurtosis_pop(f0)', 4)} f0_kurtosis, {R('avg(pow((f0 - a) / s, 3))', 4)} f0_skewness FROM v JOIN m USING (user_id) GROUP BY 1),
 u AS (SELECT user_id, {R('100 * (1 - count(*) FILTER (f0 > 0) / CAST(count(*) AS DOUBLE))', 4)} silence_ratio, {R('1 / (any_value(n) / 100e0 - 0.27e0)', 4)} spir FROM f GROUP BY 1) SELECT u.*, x.* EXCLUDE (user_id) FROM u LEFT JOIN x USING (user_id)""")
def voice_summary(spark, sf_dir):
    from . import voice

    got = voice.vocal_summary(*_voice(spark, sf_dir), ["user_id"])
    digits = {"silence_ratio": 4, "spir": 4, "f0_mean": 3, "f0_stddev": 3, "f0_range": 2, "rel_f0_sd": 5, "rel_se0_sd": 5, "f0_kurtosis": 4, "f0_skewness": 4}
    return got.select("user_id", *[r(F.col(c), d).alias(c) for c, d in digits.items()])


@query(f"SELECT substr(event_type, 1, 1) AS phonation_type, {R('avg(value)', 4)} f0_mean FROM events GROUP BY 1")
def phonation_summary(spark, sf_dir):
    from . import voice

    per = C.words(spark, sf_dir).select(F.lit(1).alias("recording_id"), F.concat(F.lit("S1_"), "event_type", F.lit("0.wav")).alias("name"), F.col("value").alias("f0_mean"), F.lit(1.0).alias("spir"))
    return voice.phonation_summary(per, ["recording_id"]).select("phonation_type", r(F.col("f0_mean"), 4).alias("f0_mean"))


@query(f"""WITH {C._E}, d AS (SELECT a.label, a.n, {_DIST} d, a.v[64] mo FROM e a LEFT JOIN e b ON a.label = b.label AND b.n = a.n - 1), o AS (SELECT label, CASE WHEN d[1] IS NOT NULL THEN list_sum(d) / 21 END o, mo, n % 3 = 0 sp FROM d), b AS (SELECT label, avg(o) b FROM o GROUP BY 1),
 x AS (SELECT label, (o + 1) / (b + 1) - 1 r, mo, sp FROM o JOIN b USING (label)) SELECT label, {R('avg(r) FILTER (sp)', 5)} overall_speaking, {R('avg(r) FILTER (NOT sp)', 5)} overall_not_speaking, {R('stddev_samp(mo) FILTER (sp)', 5)} mouth_std_speaking FROM x GROUP BY 1""")
def facial_expressivity(spark, sf_dir):
    """Displacements as ratios to a baseline, here the recording itself, split by speaking."""
    n = F.row_number().over(S.in_order(["label"], ["vec_id"]))
    mouth = C._vectors(spark, sf_dir).select("label", "vec_id", F.get("v", F.lit(63)).alias("mouth_openness"), F.when(n % 3 == 0, 0.9).otherwise(0.1).alias("p"))
    frames = _frames(spark, sf_dir).join(mouth, ["label", "vec_id"])
    got = motion.facial_expressivity(frames, ["label"], "vec_id", {"lower_face": _LOWER}, 21, base=frames, probability="p")[1]
    return got.select("label", r(F.col("overall_mean_speaking"), 5).alias("overall_speaking"), r(F.col("overall_mean_not_speaking"), 5).alias("overall_not_speaking"), r(F.col("mouth_openness_std_speaking"), 5).alias("mouth_std_speaking"))


@query(f"WITH b AS (SELECT l_returnflag, avg(l_tax) t, avg(l_discount) d FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT l_returnflag, {R('avg((l_tax + 1) / (t + 1) - 1)', 7)} tax_mean, {R('stddev_samp((l_discount + 1) / (d + 1) - 1)', 6)} discount_std FROM lineitem JOIN b USING (l_returnflag) GROUP BY 1")
def emotional_expressivity(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_tax", "l_discount")
    got = motion.emotional_expressivity(i, ["l_returnflag"], ["l_tax", "l_discount"], i.where("l_linestatus = 'F'"))
    return got.select("l_returnflag", r(F.col("l_tax_mean"), 7).alias("tax_mean"), r(F.col("l_discount_std"), 6).alias("discount_std"))


@query(f"WITH {C.W}, b AS (SELECT user_id, count(*) FILTER (event_type = 'click') n, count(*) f FROM w GROUP BY 1) SELECT user_id, n AS blinks, {R('n / (f / 30e0) * 60', 3)} blink_rate FROM b")
def blink_summary(spark, sf_dir):
    e = C.words(spark, sf_dir)
    rec = e.groupBy("user_id").agg(F.count("*").alias("n_frames")).withColumn("fps", F.lit(30.0))
    return motion.blink_summary(rec, e.where("event_type = 'click'"), ["user_id"]).select("user_id", "blinks", r(F.col("blink_rate"), 3).alias("blink_rate"))


@query("SELECT event_id, CAST(floor(event_id / 30e0 * 1000 + 0.5) AS BIGINT) peak_ms, CAST(floor((event_id + 3) / 30e0 * 1000 + 0.5) AS BIGINT) end_ms FROM events")
def blink_times(spark, sf_dir):
    b = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("blink_peak_frame"), (F.col("event_id") - 2).alias("blink_starting_frame"), (F.col("event_id") + 3).alias("blink_ending_frame"))
    return motion.blink_times(b, F.lit(30.0)).select("event_id", r(F.col("blink_peak_time"), 3).alias("peak_ms"), r(F.col("blink_ending_time"), 3).alias("end_ms"))


@query(f"""WITH {C.W}, z AS (SELECT user_id, row_number() {C.P} - 1 i, -(value - avg(value) OVER (PARTITION BY user_id)) / stddev_samp(value) OVER (PARTITION BY user_id) y, count(*) OVER (PARTITION BY user_id) n FROM w),
 p AS (SELECT * FROM (SELECT *, lag(y) OVER o ly, lead(y) OVER o ry FROM z WINDOW o AS (PARTITION BY user_id ORDER BY i)) WHERE y > ly AND y > ry),
 b AS (SELECT p.user_id, p.i, any_value(p.y) y, any_value(p.n) n, coalesce(max(q.i) FILTER (q.i < p.i AND q.y > p.y), 0) lo, coalesce(min(q.i) FILTER (q.i > p.i AND q.y > p.y), any_value(p.n) - 1) hi FROM p JOIN z q USING (user_id) GROUP BY 1, 2),
 m AS (SELECT b.user_id, b.i, any_value(b.y) y, any_value(n) n, any_value(b.y) - greatest(min(q.y) FILTER (q.i BETWEEN lo AND b.i), min(q.y) FILTER (q.i BETWEEN b.i AND hi)) prom FROM b JOIN (SELECT user_id, i, y FROM z) q USING (user_id) GROUP BY 1, 2),
 l AS (SELECT m.*, m.y - prom / 2 lev FROM m WHERE prom >= 2),
 e AS (SELECT l.user_id, l.i, any_value(lev) lev, coalesce(max(q.i) FILTER (q.i <= l.i AND q.y <= lev), 0) a, coalesce(min(q.i) FILTER (q.i >= l.i AND q.y <= lev), any_value(l.n) - 1) b FROM l JOIN (SELECT user_id, i, y FROM z) q USING (user_id) GROUP BY 1, 2),
 f AS (SELECT e.user_id, e.i, CASE WHEN ya.y < lev THEN a + (lev - ya.y) / (yb.y - ya.y) ELSE a END s, CASE WHEN yc.y < lev THEN b - (lev - yc.y) / (yd.y - yc.y) ELSE b END t FROM e JOIN z ya ON ya.user_id = e.user_id AND ya.i = a JOIN z yb ON yb.user_id = e.user_id AND yb.i = a + 1 JOIN z yc ON yc.user_id = e.user_id AND yc.i = b JOIN z yd ON yd.user_id = e.user_id AND yd.i = b - 1)
 SELECT user_id, CAST(i AS INT) peak, {R('s', 4)} start_e4, {R('t', 4)} end_e4 FROM f WHERE t - s >= 0.01""")
def blink_detection(spark, sf_dir):
    from . import models

    return models.blinks(spark, sf_dir).select("user_id", "peak", r(F.col("start"), 4).alias("start_e4"), r(F.col("end"), 4).alias("end_e4"))


# -- models and their results -----------------------------------------------------

_LEX = {"the": 0.5, "of": -1.0, "and": 2.0, "in": -0.5}


@query(f"""WITH d AS (SELECT conv_id, turn, list_transform({_TOK}, lambda w: CASE w {' '.join(f"WHEN '{w}' THEN {v}e0" for w, v in _LEX.items())} ELSE 0e0 END) v FROM conversations),
 s AS (SELECT *, coalesce(list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN x + 1 ELSE 0e0 END)), 0) p, coalesce(list_sum(list_transform(v, lambda x: CASE WHEN x < 0 THEN 1 - x ELSE 0e0 END)), 0) g, CAST(len(list_filter(v, lambda x: x = 0)) AS DOUBLE) z, coalesce(list_sum(v), 0e0) t FROM d)
 SELECT conv_id, turn, {R('g / nullif(p + g + z, 0)', 5)} neg, {R('z / nullif(p + g + z, 0)', 5)} neu, {R('p / nullif(p + g + z, 0)', 5)} pos, {R('t / sqrt(t * t + 15)', 5)} compound FROM s""")
def sentiment(spark, sf_dir):
    """Sentiment by a lexicon of four words; a real one is a parameter."""
    from ..models import adapters

    lexicon = F.create_map(*[F.lit(x) for kv in _LEX.items() for x in kv])
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", adapters.sentiment(T.tokens(F.col("text")), lexicon).alias("s"))
    return c.select("conv_id", "turn", *[r(F.col(f"s.{k}"), 5).alias(k) for k in ("neg", "neu", "pos", "compound")])


@query(f"WITH {C.W}, p AS (SELECT user_id, count(*) n, avg(ln((k + 1) / 101)) a FROM w GROUP BY 1) SELECT user_id, {R('CASE WHEN n >= 2 THEN exp(-a) END', 4)} semantic_perplexity FROM p")
def perplexity(spark, sf_dir):
    from ..models import adapters

    p = C.words(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.ln((F.col("k") + 1) / 101)).alias("lp"))
    return p.select("user_id", r(adapters.perplexity(F.col("lp")), 4).alias("semantic_perplexity"))


@query(f"""WITH {C.W}, n AS (SELECT user_id, row_number() {C.P} - 1 f, value < 250 q FROM w), i AS (SELECT *, f - row_number() OVER (PARTITION BY user_id, q ORDER BY f) g FROM n)
 SELECT user_id, CAST(min(f) AS BIGINT) first_frame, count(*) n_frames FROM i WHERE q GROUP BY user_id, g HAVING count(*) >= 2""")
def silences(spark, sf_dir):
    """Stretches of quiet frames, two frames (a second) or longer."""
    from ..models import adapters

    n = C.words(spark, sf_dir).withColumn("f", F.row_number().over(S.in_order(C.BY, C.ORDER)) - 1)
    s = adapters.silences(n, ["user_id"], "f", "value", 250.0, 2, 1.0)
    return s.select("user_id", F.round(F.col("pause_start") * 2).cast("long").alias("first_frame"), F.round(F.col("pause_duration") * 2).cast("long").alias("n_frames"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings) SELECT vec_id, CAST(floor(v[1] * 1e6 + 0.5) AS BIGINT) lmk001_x, CAST(floor(v[63] * 1e6 + 0.5) AS BIGINT) lmk021_z, 21 AS points FROM e""")
def wide_landmarks(spark, sf_dir):
    """Landmarks as columns and back."""
    from ..models import adapters

    wide = adapters.wide_landmarks(_frames(spark, sf_dir), 21)
    back = adapters.landmark_arrays(wide.withColumnsRenamed({}), 21).select("vec_id", F.size("landmarks").alias("points"))
    return wide.select("vec_id", r(F.col("lmk001_x"), 6).alias("lmk001_x"), r(F.col("lmk021_z"), 6).alias("lmk021_z")).join(back, "vec_id")


@query("SELECT conv_id, turn, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS place, unnest(ws) AS word FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') ws FROM conversations)")
def table_function(spark, sf_dir):
    """Words by a registered table function in SQL."""
    from ..models import adapters

    adapters.register(spark)
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").createOrReplaceTempView("pulsegrid_turns")
    return spark.sql("SELECT conv_id, turn, w.at AS place, w.word FROM pulsegrid_turns, LATERAL words_of(text) w")


@query("SELECT DISTINCT user_id, CAST(NULL AS DOUBLE) AS turn_to_turn_tangeniality_slope, 73 AS n_columns FROM events")
def rows_of_nulls(spark, sf_dir):
    """Recordings without a result have a row of nulls with every column of the table."""
    from .. import schemas

    recs = table(spark, sf_dir, "events").select("user_id").distinct()
    full = schemas.complete(schemas.empty(spark, "speech.summary", "user_id long"), recs, ["user_id"], "speech.summary")
    return full.select("user_id", "turn_to_turn_tangeniality_slope", F.lit(len(full.columns) - 1).alias("n_columns"))


# -- files and streams --------------------------------------------------------------


@query("SELECT user_id, epoch_us(date_trunc('hour', ts)) hour_us, count(*) n, CAST(floor(sum(value) * 10 + 0.5) AS BIGINT) total_e1 FROM events GROUP BY 1, 2")
def hourly_stream(spark, sf_dir):
    """The hourly windows as a stream, run to the end of what is there."""
    from ..streaming.windows import hourly_counts, run_once

    got = run_once(hourly_counts(spark, f"{sf_dir}/events.parquet"), "hourly")
    return got.select("user_id", F.unix_micros("hour").alias("hour_us"), "n", r(F.col("total"), 1).alias("total_e1"))


@query("SELECT event_id * 1000 AS timestamp, CAST(floor(value * 100 + 0.5) AS BIGINT) latitude_e2, CAST(json_extract_string(props, '$.k') AS BIGINT) longitude FROM events")
def gps_csv(spark, sf_dir):
    """Location files with exactly the header that is asked for, written and read back."""
    import uuid

    from ..storage import shared_folder

    folder = f"{shared_folder(spark)}/gps-{uuid.uuid4().hex}"
    e = C.words(spark, sf_dir).select((F.col("event_id") * 1000).alias("timestamp"), F.col("value").alias("latitude"), F.col("k").alias("longitude"), F.lit(1.0).alias("accuracy"))
    e.write.option("header", True).csv(folder)
    return transcripts.read_gps(spark, folder).select("timestamp", r(F.col("latitude"), 2).alias("latitude_e2"), F.col("longitude").cast("long").alias("longitude"))
