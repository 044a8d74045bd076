"""Transcripts, events, notes and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import providers
from tapeloom.functions import codec, text
from tapeloom.operators import notes, store, transcripts
from tapeloom.plans import sql
from tapeloom.session import kept
from tapeloom.sources import tables


def _parsed(spark, sf_dir):
    chunks = tables.chunk_responses(spark, sf_dir)
    return transcripts.parse_responses(transcripts.with_offsets(chunks))


def chunk_merge_text(spark, sf_dir):
    merged = transcripts.merge_chunks(_parsed(spark, sf_dir))
    return merged.select(
        "session_id",
        "channel",
        "part",
        "text",
        F.get_json_object("raw_response", "$.text").alias("raw_text"),
        F.get_json_object("raw_response", "$.chunks[0].text").alias("first_raw_text"),
    )


def chunk_merge_segments(spark, sf_dir):
    merged = transcripts.merge_chunks(_parsed(spark, sf_dir))
    return merged.select(
        "session_id", "channel", "part", F.posexplode("segments").alias("position", "segment")
    ).select(
        "session_id",
        "channel",
        "part",
        F.col("position").cast("bigint").alias("position"),
        F.round("segment.start", 6).alias("seg_start"),
        F.round("segment.end", 6).alias("seg_end"),
        F.col("segment.text").alias("text"),
    )


def running_partials(spark, sf_dir):
    parsed = transcripts.parse_responses(tables.chunk_responses(spark, sf_dir))
    return transcripts.running_partials(parsed)


def final_partials(spark, sf_dir):
    """The last update of every channel, written out in full."""
    parsed = _parsed(spark, sf_dir)
    partials = transcripts.running_partials(parsed)
    last = partials.groupBy("session_id", "channel").agg(
        F.max("chunk_index").alias("chunk_index"),
        F.max("part").alias("part"),
        F.max_by("text_length", "chunk_index").alias("text_length"),
        F.max_by("n_segments", "chunk_index").alias("n_segments"),
        F.max_by("n_entries", "chunk_index").alias("n_entries"),
    )
    full = transcripts.partial_texts(last, transcripts.merge_chunks(parsed))
    return full.select(
        "session_id",
        "channel",
        "part",
        "chunk_index",
        "text",
        F.size("segments").cast("bigint").alias("n_segments"),
        F.size(F.try_variant_get(F.try_parse_json("raw_response"), "$.chunks", "array<variant>"))
        .cast("bigint")
        .alias("n_entries"),
    )


def emit_if_changed(spark, sf_dir):
    """Updates of all channels and their final records, unless these repeat the last update."""
    # Lengths and counts do not depend on the offsets of the chunks.
    return providers.updates(transcripts.parse_responses(tables.chunk_responses(spark, sf_dir)))


def delta_fold_final(spark, sf_dir):
    """The final transcripts of all streamed channels after their closing responses."""
    closings = tables.closing_responses(spark, sf_dir)
    finals = transcripts.final_records(_folded(spark, sf_dir, True), closings)
    return finals.select(
        "session_id",
        "part",
        "text",
        F.size("segments").cast("bigint").alias("n_segments"),
        F.get(F.col("segments"), F.lit(0))["text"].alias("first_segment"),
        "raw_response",
    )


def paged_outcome(spark, sf_dir):
    """Merge into very short pages, log two transcriptions, read the newest back: the pages must not show."""
    parsed = _parsed(spark, sf_dir)
    older = kept(store.numbered_transcripts(transcripts.merge_chunks(parsed, 1), ["channel"]), "older")
    newer = store.numbered_transcripts(transcripts.merge_chunks(parsed, 2), ["channel"], older)
    log = kept(store.append_transcripts(older.withColumn("text", F.upper("text")), newer), "log")
    latest = store.latest_per_channel(log)
    sessions = log.select(F.col("session_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("call "), "id"))
    found = notes.default_notes(sessions, latest)
    outcome = store.session_outcomes(sessions, log, found)

    def joined(value, order, separator, keep=None):
        items = F.sort_array(F.collect_list(F.when(keep, F.struct(order, value)) if keep is not None else F.struct(order, value)))
        return F.array_join(F.transform(items, lambda item: item[value]), separator)

    texts = outcome.groupBy("id", "channel", "title", "summary").agg(
        joined("text", "part", "\n", F.col("text") != "").alias("text"), F.count("*").alias("n_parts")
    )
    shown = transcripts.render_sessions(latest, pieces=3).groupBy(F.col("session_id").alias("id")).agg(
        joined("content", "part", "").alias("content")
    )
    combined = notes.combined_texts(latest, 2).groupBy(F.col("session_id").alias("id")).agg(
        joined("combined", "part", "\n").alias("combined")
    )
    prompted = notes.prompts(latest, 2).groupBy(F.col("session_id").alias("id")).agg(
        joined("prompt", "part", "\n").alias("prompt")
    )
    return texts.join(shown, "id").join(combined, "id").join(prompted, "id", "left")


def chunk_offsets(spark, sf_dir):
    offsets = transcripts.with_offsets(tables.chunk_responses(spark, sf_dir))
    return offsets.select(
        "session_id", "channel", "chunk_index", F.round("start", 6).alias("start"), "duration"
    )


def event_decode(spark, sf_dir):
    lines = tables.transcript_events(spark, sf_dir)
    return lines.withColumn("event", codec.decode_event(F.col("line"))).select(
        "session_id", "seq", "event.is_stop", "event.piece"
    )


def _folded(spark, sf_dir, stops):
    return transcripts.fold_events(tables.transcript_events(spark, sf_dir, stops))


def _updates(folded):
    return folded.filter("emitted").select("session_id", "seq", "piece", "raw_end", "n_segments")


def delta_fold(spark, sf_dir):
    return _updates(_folded(spark, sf_dir, True))


def delta_fold_open(spark, sf_dir):
    return _updates(_folded(spark, sf_dir, False))


def delta_fold_text(spark, sf_dir):
    folded = transcripts.folded_texts(_folded(spark, sf_dir, False))
    return folded.select("session_id", "part", text.strip(F.col("raw_text")).alias("text"))


def response_normalise(spark, sf_dir):
    parsed = transcripts.parse_responses(tables.chunk_responses(spark, sf_dir))
    return parsed.select(
        "session_id",
        "channel",
        "chunk_index",
        "text",
        F.size("segments").cast("bigint").alias("n_segments"),
        F.get(F.col("segments"), F.lit(0))["text"].alias("first_segment"),
        F.round(F.get(F.col("segments"), F.lit(0))["end"], 6).alias("first_end"),
        F.col("raw_response").isNotNull().alias("has_raw"),
    )


def word_counts(spark, sf_dir):
    docs = tables.document_transcripts(spark, sf_dir)
    return docs.select("row_id", "channel", text.word_count(F.col("text")).alias("n_words"))


def _padded():
    return F.concat(F.lit("\t\n  "), F.col("text"), F.lit(" \x1c \r\n"))


def strip_text(spark, sf_dir):
    docs = tables.document_transcripts(spark, sf_dir)
    stripped = text.strip(_padded())
    return docs.select(
        "row_id", F.md5(stripped).alias("digest"), F.length(stripped).cast("bigint").alias("n_chars")
    )


def preview_sentence(spark, sf_dir):
    docs = tables.document_transcripts(spark, sf_dir)
    return docs.select("row_id", text.preview_sentence(F.col("text")).alias("preview"))


def notes_summary(spark, sf_dir):
    return notes.summaries(tables.document_transcripts(spark, sf_dir))


def notes_documents(spark, sf_dir):
    """Notes of the built-in generator for all sessions with a transcript."""
    sessions = store.compact_sessions(tables.session_log(spark, sf_dir))
    found = notes.default_notes(sessions, tables.transcripts(spark, sf_dir))
    return found.select("session_id", "title", "summary", F.size("action_items").cast("bigint").alias("n_items"))


def notes_combine(spark, sf_dir):
    combined = notes.combined_texts(tables.document_transcripts(spark, sf_dir))
    return combined.select(
        "session_id",
        "part",
        F.md5("combined").alias("digest"),
        F.length("combined").cast("bigint").alias("n_chars"),
    )


def notes_prompt(spark, sf_dir):
    prompts = notes.prompts(tables.document_transcripts(spark, sf_dir))
    return prompts.select(
        "session_id",
        "part",
        F.md5("prompt").alias("digest"),
        F.length("prompt").cast("bigint").alias("n_chars"),
    )


def render_transcript(spark, sf_dir):
    latest = store.latest_per_channel(tables.transcripts(spark, sf_dir))
    return transcripts.render_sessions(latest).select("session_id", "part", "content")


def path_stem(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        text.file_name(F.col("url")).alias("file_name"),
        text.path_stem(F.col("url")).alias("stem"),
    )


def placeholder_transcript(spark, sf_dir):
    path = F.concat(F.lit("rec/"), F.col("c_custkey").cast("string"), F.lit("/processed/mix.wav"))
    customers = tables.table(spark, sf_dir, "customer")
    return customers.select("c_custkey", text.placeholder_text(F.col("c_name"), path).alias("text"))


QUERIES = {
    "chunk_merge_text": chunk_merge_text,
    "chunk_merge_segments": chunk_merge_segments,
    "running_partials": running_partials,
    "final_partials": final_partials,
    "emit_if_changed": emit_if_changed,
    "delta_fold_final": delta_fold_final,
    "paged_outcome": paged_outcome,
    "chunk_offsets": chunk_offsets,
    "event_decode": event_decode,
    "delta_fold": delta_fold,
    "delta_fold_open": delta_fold_open,
    "delta_fold_text": delta_fold_text,
    "response_normalise": response_normalise,
    "word_counts": word_counts,
    "strip_text": strip_text,
    "preview_sentence": preview_sentence,
    "notes_summary": notes_summary,
    "notes_documents": notes_documents,
    "notes_combine": notes_combine,
    "notes_prompt": notes_prompt,
    "render_transcript": render_transcript,
    "path_stem": path_stem,
    "placeholder_transcript": placeholder_transcript,
}

_MERGED_TEXT = f"coalesce(string_agg(trim(text, {sql.WS}), chr(10) ORDER BY chunk_index) FILTER (trim(text, {sql.WS}) <> ''), '')"


def _delta(stops: bool) -> str:
    return sql.with_(
        sql.events(stops),
        body=f"""SELECT session_id, seq, piece, raw_end, n_segments FROM (
          SELECT *, CAST(length(string_agg(piece, '') OVER w) AS BIGINT) AS raw_end,
                 CAST(count(*) FILTER (trim(piece, {sql.WS}) <> '') OVER w AS BIGINT) AS n_segments
          FROM (SELECT *, count(*) FILTER (is_stop) OVER
                  (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stops FROM decoded)
          WHERE piece IS NOT NULL AND stops = 0
          WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
        WHERE n_segments > 0""",
    )


def _summary(combined: str) -> str:
    return f"""CASE WHEN {combined} = '' THEN 'No transcript available.'
      WHEN length({combined}) > 280 THEN substring({combined}, 1, 280) || '...' ELSE {combined} END"""


ORACLES = {
    "chunk_merge_text": sql.with_(
        sql.RESPONSES,
        body=f"""SELECT session_id, channel, CAST(0 AS BIGINT) AS part, {_MERGED_TEXT} AS text,
          nullif({_MERGED_TEXT}, '') AS raw_text, arg_min(text, chunk_index) AS first_raw_text
        FROM parsed GROUP BY session_id, channel""",
    ),
    "chunk_merge_segments": sql.with_(
        sql.RESPONSES,
        body="""SELECT session_id, channel, CAST(0 AS BIGINT) AS part,
          row_number() OVER (PARTITION BY session_id, channel ORDER BY chunk_index, n) - 1 AS position,
          round(seg_start + chunk_start, 6) AS seg_start, round(seg_end + chunk_start, 6) AS seg_end, text
        FROM segments""",
    ),
    "running_partials": sql.with_(
        sql.RESPONSES,
        body=f"""SELECT session_id, channel, CAST(0 AS BIGINT) AS part, chunk_index, appended,
          length(coalesce(string_agg(nullif(appended, ''), chr(10)) OVER w, '')) AS text_length,
          CAST(coalesce(sum(n_own) OVER w, 0) AS BIGINT) AS n_segments, count(*) OVER w AS n_entries
        FROM (SELECT *, trim(text, {sql.WS}) AS appended, CASE WHEN shape IN (0, 2) THEN 2 ELSE 0 END AS n_own FROM parsed)
        WINDOW w AS (PARTITION BY session_id, channel ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)""",
    ),
    "final_partials": sql.with_(
        sql.RESPONSES,
        body=f"""SELECT session_id, channel, CAST(0 AS BIGINT) AS part, max(chunk_index) AS chunk_index,
          {_MERGED_TEXT} AS text,
          CAST(sum(CASE WHEN shape IN (0, 2) THEN 2 ELSE 0 END) AS BIGINT) AS n_segments, count(*) AS n_entries
        FROM parsed GROUP BY session_id, channel""",
    ),
    # The final record carries the whole text in its raw response; only an empty one repeats the last update.
    "emit_if_changed": sql.with_(
        sql.RESPONSES,
        body=f"""SELECT session_id, channel, chunk_index,
          length(coalesce(string_agg(nullif(appended, ''), chr(10)) OVER w, '')) AS text_length,
          CAST(sum(n_own) OVER w AS BIGINT) AS n_segments, count(*) OVER w AS n_entries, false AS has_text, false AS is_final
        FROM (SELECT *, trim(text, {sql.WS}) AS appended, CASE WHEN shape IN (0, 2) THEN 2 ELSE 0 END AS n_own FROM parsed)
        WINDOW w AS (PARTITION BY session_id, channel ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)
        UNION ALL
        SELECT session_id, channel, NULL, length({_MERGED_TEXT}),
          CAST(sum(CASE WHEN shape IN (0, 2) THEN 2 ELSE 0 END) AS BIGINT), count(*), true, true
        FROM parsed GROUP BY session_id, channel HAVING {_MERGED_TEXT} <> ''""",
    ),
    "delta_fold_final": sql.with_(
        sql.events(),
        body=f"""SELECT e.session_id, CAST(0 AS BIGINT) AS part,
          CASE k WHEN 0 THEN ' final ' || last || ' ' ELSE coalesce(t.text, '') END AS text,
          CAST(CASE k WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS n_segments, CASE k WHEN 0 THEN 'a' END AS first_segment,
          CASE k WHEN 0 THEN '{{"text":" final ' || last || ' ","segments":[{{"start":0,"end":1.5,"text":" a "}}]}}'
                 WHEN 1 THEN '{{"id":' || last || '}}' END AS raw_response
        FROM (SELECT session_id, max(seq) AS last, max(seq) % 4 AS k FROM decoded GROUP BY session_id) e
        LEFT JOIN (SELECT session_id, trim(string_agg(piece, '' ORDER BY seq), {sql.WS}) AS text
                   FROM (SELECT *, count(*) FILTER (is_stop) OVER
                           (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stops FROM decoded)
                   WHERE piece IS NOT NULL AND stops = 0 GROUP BY session_id) t ON t.session_id = e.session_id""",
    ),
    # Knows no pages: whole texts per channel and session.
    "paged_outcome": sql.with_(
        sql.RESPONSES,
        f"""
whole AS (SELECT session_id, channel, {_MERGED_TEXT} AS text, count(DISTINCT chunk_index // 2) AS n_parts,
    coalesce(bool_or(shape IN (0, 2)), false) AS has_segments FROM parsed GROUP BY session_id, channel),
lines AS (SELECT session_id, channel, string_agg(CASE WHEN seg_start IS NOT NULL AND seg_end IS NOT NULL
      THEN format('  {{:6.2f}}-{{:6.2f}}s  {{}}', seg_start + chunk_start, seg_end + chunk_start, text)
      ELSE '  ' || text END, chr(10) ORDER BY chunk_index, n) AS timed FROM segments GROUP BY session_id, channel),
blocks AS (SELECT w.*, '[' || w.channel || ']' || coalesce(chr(10) || timed, '') || CASE WHEN text = '' THEN ''
      WHEN has_segments THEN chr(10) || '  Full text:' || chr(10) || '    ' || text ELSE chr(10) || '  ' || text END AS block
    FROM whole w LEFT JOIN lines l ON l.session_id = w.session_id AND l.channel = w.channel),
calls AS (SELECT session_id, rtrim(string_agg(block, chr(10) || chr(10) ORDER BY channel), {sql.WS}) AS content,
      string_agg(text, chr(10) ORDER BY channel) AS combined,
      string_agg('[' || channel || '] ' || text, chr(10) ORDER BY channel) FILTER (text <> '') AS prompt
    FROM blocks GROUP BY session_id)""",
        body=f"""SELECT session_id AS id, channel, 'Notes for call ' || session_id AS title, {_summary("combined")} AS summary,
          text, n_parts, content, combined, prompt
        FROM whole JOIN calls USING (session_id)""",
    ),
    "chunk_offsets": sql.with_(
        sql.RESPONSES,
        body="SELECT session_id, channel, chunk_index, round(start, 6) AS start, duration FROM parsed",
    ),
    "event_decode": sql.with_(sql.events(), body="SELECT session_id, seq, is_stop, piece FROM decoded"),
    "delta_fold": _delta(True),
    "delta_fold_open": _delta(False),
    "delta_fold_text": sql.with_(
        sql.events(False),
        body=f"""SELECT session_id, CAST(0 AS BIGINT) AS part,
          trim(string_agg(piece, '' ORDER BY seq), {sql.WS}) AS text
        FROM decoded WHERE piece IS NOT NULL GROUP BY session_id""",
    ),
    "response_normalise": sql.with_(
        sql.RESPONSES,
        body="""SELECT p.session_id, p.channel, p.chunk_index, p.text,
          CAST(CASE WHEN shape IN (0, 2) THEN 2 ELSE 0 END AS BIGINT) AS n_segments,
          s.text AS first_segment, round(s.seg_end, 6) AS first_end, shape <> 9 AS has_raw
        FROM parsed p LEFT JOIN segments s ON s.n = 0 AND s.session_id = p.session_id
          AND s.channel = p.channel AND s.chunk_index = p.chunk_index""",
    ),
    "word_counts": f"""
        SELECT doc_id AS row_id, lang AS channel,
          CAST(len(list_filter(regexp_split_to_array(text, '[{sql.WHITESPACE}]+'), lambda x: x <> '')) AS BIGINT) AS n_words
        FROM documents""",
    "strip_text": f"""
        SELECT doc_id AS row_id, md5(s) AS digest, CAST(length(s) AS BIGINT) AS n_chars
        FROM (SELECT doc_id, trim(chr(9) || chr(10) || ' ' || chr(160) || text || ' ' || chr(28) || chr(8195) || chr(13) || chr(10), {sql.WS}) AS s
              FROM documents)""",
    "preview_sentence": f"""
        SELECT doc_id AS row_id, nullif(trim(split_part(text, '. ', 1), {sql.WS}), '') AS preview FROM documents""",
    "notes_summary": f"""
        SELECT session_id, {_summary("combined")} AS summary FROM (
          SELECT source AS session_id, string_agg(text, chr(10) ORDER BY doc_id) AS combined
          FROM documents GROUP BY source)""",
    "notes_documents": sql.with_(
        sql.SESSIONS,
        sql.TRANSCRIPTS,
        body=f"""SELECT session_id, 'Notes for ' || name AS title, {_summary("combined")} AS summary, CAST(0 AS BIGINT) AS n_items
        FROM (SELECT session_id, string_agg(text, chr(10) ORDER BY row_id) AS combined
              FROM transcripts GROUP BY session_id) t JOIN sessions s ON s.id = t.session_id""",
    ),
    "notes_combine": """
        SELECT source AS session_id, CAST(0 AS BIGINT) AS part, md5(c) AS digest, length(c) AS n_chars FROM (
          SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS c FROM documents GROUP BY source)""",
    "notes_prompt": """
        SELECT source AS session_id, CAST(0 AS BIGINT) AS part, md5(c) AS digest, length(c) AS n_chars FROM (
          SELECT source, string_agg('[' || lang || '] ' || text, chr(10) ORDER BY doc_id) FILTER (text <> '') AS c
          FROM documents GROUP BY source)""",
    "render_transcript": sql.with_(
        sql.TRANSCRIPTS,
        body=f"""SELECT session_id, CAST(0 AS BIGINT) AS part, rtrim(string_agg(block, chr(10) || chr(10) ORDER BY channel), {sql.WS}) AS content FROM (
          SELECT session_id, channel, '[' || channel || ']' || chr(10) ||
            CASE WHEN seg_start IS NULL THEN '  ' || text
                 ELSE format('  {{:6.2f}}-{{:6.2f}}s  {{}}', seg_start, seg_end, text) END ||
            CASE WHEN trim(text, {sql.WS}) = '' THEN ''
                 ELSE chr(10) || '  Full text:' || chr(10) || '    ' || trim(text, {sql.WS}) END AS block
          FROM (SELECT * FROM transcripts
                QUALIFY row_number() OVER (PARTITION BY session_id, channel ORDER BY row_id DESC) = 1))
        GROUP BY session_id""",
    ),
    "path_stem": r"""
        SELECT page_id, name AS file_name,
          CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_extract(name, '^(.+)\.[^.]+$', 1) ELSE name END AS stem
        FROM (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name FROM pages)""",
    "placeholder_transcript": f"""
        SELECT c_custkey, printf('{text.PLACEHOLDER_TEXT.replace("'", "''")}', c_name, 'mix.wav') AS text FROM customer""",
}
