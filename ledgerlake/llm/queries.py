"""One registered query per operator of this package, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    chat_snapshots,
    conversation_repair,
    counterfactual_toxicity,
    entropy_mixing,
    entropy_secrets,
    golay_simhash,
    importance_resampling,
    kd_shards,
    pruned_graph,
    quality_rules,
    radix_suffix,
    warc_index,
    window_decontamination,
)
from .common import load

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_chat_snapshots(spark, sf):
    return chat_snapshots.format_chats(load(spark, sf, "conversations"))


@query
def op2_kd_shards(spark, sf):
    placed = kd_shards.kd_shards(load(spark, sf, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_golay_simhash(spark, sf):
    return golay_simhash.near_duplicates(load(spark, sf, "documents"))


@query
def op4_window_decontamination(spark, sf):
    found = window_decontamination.contaminated(load(spark, sf, "documents"), load(spark, sf, "benchmark"))
    return found.drop("row_key")


@query
def op5_entropy_secrets(spark, sf):
    return entropy_secrets.secret_report(load(spark, sf, "documents"))


@query
def op6_pruned_graph(spark, sf):
    return pruned_graph.linked_vectors(load(spark, sf, "embeddings"))


@query
def op7_entropy_mixing(spark, sf):
    return entropy_mixing.mixture(load(spark, sf, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken"
    )


@query
def op8_radix_suffix(spark, sf):
    return radix_suffix.repeated_passages(load(spark, sf, "documents")).drop("spans")


@query
def op9_counterfactual_toxicity(spark, sf):
    return counterfactual_toxicity.score_documents(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query
def op10_warc_index(spark, sf):
    return warc_index.archive_round_trip(load(spark, sf, "pages"))


@query
def op11_importance_resampling(spark, sf):
    return importance_resampling.resampled(load(spark, sf, "documents"), load(spark, sf, "benchmark")).drop("n_words")


@query
def op12_conversation_repair(spark, sf):
    turns = load(spark, sf, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(turns), turns)


@query
def op13_quality_rules(spark, sf):
    report = quality_rules.quality_report(load(spark, sf, "documents"))
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.array_join("broken", ",").alias("broken"), "kept",
    )


ORACLE["op1_chat_snapshots"] = """
WITH t AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), p AS (
    SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        string_agg(length(role) || ':' || length(text) || ':' || role || text, '')
            OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS prefix,
        '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), ends AS (
    SELECT prefix, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY prefix
), kept AS (
    SELECT conv_id FROM ends WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n)
)
SELECT conv_id, n AS n_turns, (pos - 1) // 256 AS segment, string_agg(line, '' ORDER BY pos) AS rendered
FROM p WHERE conv_id IN (SELECT conv_id FROM kept)
GROUP BY ALL
"""

ORACLE["op10_warc_index"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

#: The bytewise CRC-32 table, made from its polynomial, and the sum of a text by it.
CRC_TABLE = """
crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
)"""


def crc32_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, octet_length(encode({text})) + 1),
        lambda place: ('0x' || substr(hex(encode({text})), 2 * place - 1, 2))::BIGINT),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""


ORACLE["op11_importance_resampling"] = f"""
WITH {CRC_TABLE}, texts AS (
    SELECT true AS raw, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT false, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), words AS (
    SELECT raw, r, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
    FROM texts
), buckets AS (
    SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc_table
), counted AS (
    SELECT raw, r, bucket, count(*) AS n FROM words JOIN buckets USING (word) GROUP BY ALL
), sums AS (
    SELECT bucket, coalesce(sum(n) FILTER (raw), 0) AS s, coalesce(sum(n) FILTER (NOT raw), 0) AS t FROM counted GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
    FROM sums
), weights AS (
    SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM counted JOIN gains USING (bucket) WHERE raw GROUP BY r
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT::DOUBLE + 0.5::DOUBLE)
            / 4294967296::DOUBLE)))::BIGINT AS score
    FROM texts LEFT JOIN weights USING (r) WHERE raw
), placed AS (
    SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS LAST) AS place,
        10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed
"""


def _step(state: str, edit: str, cost: str, line: str) -> str:
    """A way, longer by an edit: its cost, edits and lines."""
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', o := {state}.o || {line})"


def _made(state: str, edit: str, cost: str, role: str, text: str = "''") -> str:
    return _step(state, edit, cost, f"chr(10) || '{role}:' || {text}")


def _stay(state: str, initial: str) -> str:
    return f"CASE WHEN initial = '{initial}' AND stays THEN {_step(state, 'K', 'extra', 'chr(10) || role || chr(58) || text')} ELSE far END"


def _rerole(state: str, role: str) -> str:
    return f"CASE WHEN stays THEN {_made(state, 'R', '3 + extra', role, 'text')} ELSE far END"


def _delete(state: str) -> str:
    return _step(state, "D", "4", "''")


#: Ways to nothing, a system, a user and an assistant turn; at each place two turns may be inserted.
_WITH_INSERTS = f"""
    SELECT *, least(i2, far) AS j2, least(b3, {_made("i2", "I", "3", "assistant")}) AS j3 FROM (
        SELECT *, least(b2, {_made("b0", "I", "3", "user")}, {_made("b1", "I", "3", "user")},
            {_made("b3", "I", "3", "user")}) AS i2
        FROM ({{source}}))"""

ORACLE["op12_conversation_repair"] = f"""
WITH RECURSIVE {CRC_TABLE}, keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
), kinds AS (
    SELECT *, {crc32_sql("k")} % 20 AS kind FROM keyed, crc_table
), hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS closed
    FROM hurt
), told AS (
    SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
        CASE WHEN closed = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
            WHEN right(closed, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
    FROM placed
), turns AS (
    SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS stays,
        CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra
    FROM told
), stats AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY conv_id
), ways AS (
    SELECT conv_id, n, 0::BIGINT AS pos, struct_pack(c := 0, a := '', o := '') AS b0, struct_pack(c := 1000000000, a := '', o := '') AS b1,
        struct_pack(c := 1000000000, a := '', o := '') AS b2, struct_pack(c := 1000000000, a := '', o := '') AS b3,
        struct_pack(c := 2000000000, a := '', o := '') AS far
    FROM stats
    UNION ALL
    SELECT w.conv_id, n, pos + 1,
        {_delete("b0")}, least({_delete("b1")}, {_stay("b0", "s")}),
        least({_delete("j2")}, {_stay("b0", "u")}, {_stay("b1", "u")}, {_stay("j3", "u")},
            {_rerole("b0", "user")}, {_rerole("b1", "user")}, {_rerole("j3", "user")}),
        least({_delete("j3")}, {_stay("j2", "a")}, {_rerole("j2", "assistant")}), far
    FROM ({_WITH_INSERTS.format(source="SELECT * FROM ways WHERE pos < n")}) w
    JOIN (SELECT conv_id AS c_id, pos AS at, role, text, initial, stays, extra FROM turns) r
        ON r.c_id IS NOT DISTINCT FROM w.conv_id AND r.at = w.pos + 1
), ended AS (
    SELECT conv_id, least(b0, j3) AS way FROM ({_WITH_INSERTS.format(source="SELECT * FROM ways WHERE pos = n")})
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.c, 0)::BIGINT AS cost,
    coalesce(way.a, '') AS audit, sha256(coalesce(substr(way.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STOP_WORDS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

ORACLE["op13_quality_rules"] = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
    SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda l: trim(l, {_SPACES}) <> '') AS lines
    FROM texts
), windows AS (
    SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM cut)
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), repeats AS (
    SELECT r, sum(least(3, coalesce(i - before, 3)))::BIGINT AS n_repeat_words
    FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM again) GROUP BY r
), measured AS (
    SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
        len(list_distinct(list_intersect(string_split_regex(lower(text), '[^\\p{{L}}]+'), [{_STOP_WORDS}]))) AS n_stop_words,
        len(list_filter(lines, lambda l: regexp_matches(ltrim(l, {_SPACES}), '^[-*•]'))) AS n_bullet_lines,
        len(list_filter(lines, lambda l: regexp_matches(rtrim(l, {_SPACES}), '(\\.\\.\\.|…)$'))) AS n_cut_lines
    FROM cut LEFT JOIN repeats USING (r)
), judged AS (
    SELECT *, concat_ws(',', CASE WHEN n_words < 50 THEN 'few_words' END,
        CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_words' END,
        CASE WHEN 100 * word_chars < 300 * n_words OR 100 * word_chars > 1000 * n_words THEN 'word_length' END,
        CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END,
        CASE WHEN 100 * n_exclamations > 20 * n_words THEN 'exclamations' END,
        CASE WHEN n_stop_words < 2 THEN 'stop_words' END,
        CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 'repeated_lines' END,
        CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 'bullet_lines' END,
        CASE WHEN 100 * n_cut_lines > 30 * n_lines THEN 'cut_lines' END) AS broken
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, broken, broken = '' AS kept
FROM judged
"""
