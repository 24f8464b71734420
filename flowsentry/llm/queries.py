"""The named queries of the operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import (
    byte_bpe, conversation_repair, decontaminate, exact_dedup, html_text, quality, secret_scan, simhash, suffix_dedup,
    suffix_tree_lm, token_files, warc, whitening)
from flowsentry.llm.common import shared_folder, table


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = suffix_tree_lm.held_out(F.col("doc_id"))
    found = suffix_tree_lm.score_texts(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.equal_text_groups(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN,
                            forms=("packed", "bytes"))
    return found.select(
        "doc_id", F.expr("octet_length(packed) div 4").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secret_scan.digests(secret_scan.scan(documents, secret_scan.learn(documents)))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder,
                                  public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    found = token_files.read_token_files(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_in_shingle=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return (documents.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"),
                             quality.score(model, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= quality.KEEP_FROM).cast("int")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    found = conversation_repair.summary(conversation_repair.edits(rows, F.col("present")))
    return found.select(F.col("conv").cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal",
                        "cost", "audit", "repaired_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = shared_folder(spark, "warc"), table(spark, sf_dir, "pages")
    warc.write_archives(pages, folder)
    found = warc.read_records(warc.find(spark, folder, pages), folder, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_html_text": op5_html_text,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_files": op7_token_files,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_whitening": op12_whitening,
    "op13_warc": op13_warc,
}

def _repair_sql() -> str:
    """Costs, letters and texts of all four places folded from the last turn to the first."""
    leads, due, head = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}], [2, 2, 3, 2], {2: "user", 3: "assistant"}
    places = []
    for place in range(4):
        options, at, n, put = [], place, 0, ""
        for n in range(2):  # a second insertion before a row never helps
            def option(cost, letter, to, text, when="true", put=put, n=n):
                options.append(f"CASE WHEN {when} THEN {{'c': {3 * n} + {cost} + z.p{to}.c, 's': '{'I' * n}{letter}' || z.p{to}.s, "
                               f"'t': {put or 'CAST([] AS VARCHAR[])'} || {text} || z.p{to}.t}} END")
            option("4", "D", at, "CAST([] AS VARCHAR[])")
            for letter, to in leads[at].items():
                option("x.cut", "K", to, "[x.role || ':' || x.text]", f"x.stay AND x.initial = '{letter}'")
            option("3 + x.cut", "R", due[at], f"['{head[due[at]]}:' || x.text]", "x.stay")
            put = (put + " || " if put else "") + f"['{head[due[at]]}:']"
            at = due[at]
        # rows are compared by cost, then letters; equal ones have equal texts
        places.append(f"'p{place}': list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))")
    return f"""
        WITH raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        coded AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda a, b:
                      list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _:
                          CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
                      4294967295::BIGINT), 4294967295) % 20 AS code FROM raw),
        hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                        CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                        unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded WHERE code <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
                          row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
        judged AS (SELECT *, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                          WHEN nth > 1 THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                          lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] AS pair FROM placed),
        listed AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                          count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                          count(*) FILTER (fault = 'truncated') AS truncated,
                          count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                          list({{'role': role, 'text': text, 'initial': initial, 'stay': fault NOT IN ('blank', 'duplicate'),
                                 'cut': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END}} ORDER BY place DESC) AS rows
                   FROM judged GROUP BY conv_id),
        steps AS (SELECT conv_id, unnest(rows) AS x, generate_subscripts(rows, 1) AS i FROM listed),
        ways AS (
            WITH RECURSIVE way AS (
                SELECT conv_id, 0::BIGINT AS i, {{'p0': {{'c': 0, 's': '', 't': CAST([] AS VARCHAR[])}},
                    'p1': {{'c': 6, 's': 'II', 't': ['user:', 'assistant:']}}, 'p2': {{'c': 3, 's': 'I', 't': ['assistant:']}},
                    'p3': {{'c': 0, 's': '', 't': CAST([] AS VARCHAR[])}}}} AS z FROM listed
                UNION ALL
                SELECT w.conv_id, w.i + 1, {{{', '.join(places)}}}
                FROM way w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1)
            SELECT conv_id, z.p0 AS best FROM way
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
               coalesce(best.s, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a
        LEFT JOIN listed l ON a.conv_id IS NOT DISTINCT FROM l.conv_id
        LEFT JOIN ways w ON a.conv_id IS NOT DISTINCT FROM w.conv_id"""


ORACLES = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
        w AS (SELECT doc_id, content,
                     first_value(doc_id) OVER (PARTITION BY content ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
                     count(*) OVER (PARTITION BY content) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM w""",
    "op11_conversation_repair": _repair_sql(),
    "op13_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex,
                     row_number() OVER w AS place, first_value(page_id) OVER w AS first_id FROM p
              WINDOW w AS (PARTITION BY payload ORDER BY page_id NULLS LAST))
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - (i % 4) * 5)) & 31)::INT, 1)), '') AS payload_digest,
               CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN first_id END AS refers_to FROM d""",
}
