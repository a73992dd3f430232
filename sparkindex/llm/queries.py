"""The opN_ queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkindex.llm.common import table


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.packing import pack, pieces

    placed = pack(pieces(table(spark, sf_dir, "documents")))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.positional import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join("near_items", ",").alias("near_items"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.common import new_path
    from sparkindex.llm.warc import read_archives, with_decision, write_archives

    path = new_path(spark, "archives")
    write_archives(with_decision(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.quality import THRESHOLD, fold, quality_scores

    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.sketch import as_text, containment, fingerprints

    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        containment(F.col("edit.kept"), F.col("own.kept")).alias("edited_in_own"),
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.sharding import shard_documents

    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.quotes import conversations

    return conversations(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.extract import main_texts

    found = main_texts(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkindex.llm.licenses import license_labels

    return license_labels(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_pack": op1_pack,
    "op2_quotes": op2_quotes,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_sketch": op5_sketch,
    "op6_shards": op6_shards,
    "op7_simhash": op7_simhash,
    "op8_main_text": op8_main_text,
    "op9_licenses": op9_licenses,
    "op10_decontaminate": op10_decontaminate,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    "op10_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
        i AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k + 1:k + least(len(w), 10)], ' ') AS phrase FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
        s AS (SELECT DISTINCT n FROM i),
        g AS (SELECT doc_id, n, k, array_to_string(w[k + 1:k + n], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, s WHERE len(w) >= n)),
        m AS (SELECT DISTINCT doc_id, item, g.n, k FROM g JOIN i ON g.n = i.n AND g.phrase = i.phrase),
        h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM m) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d),
        f AS (SELECT word, count(*) AS many FROM p GROUP BY 1),
        v AS (SELECT item, n, phrase, unnest(string_split(phrase, ' ')) AS word, unnest(range(n)) AS o FROM i),
        r AS (SELECT item, phrase, arg_min(word, many * 100 + o) AS word, arg_min(o, many * 100 + o) AS o FROM v JOIN f USING (word) GROUP BY ALL),
        c AS (SELECT DISTINCT doc_id, item, phrase, place - o + shift AS s0 FROM p JOIN r USING (word), (SELECT unnest(range(-2, 3)) AS shift)),
        x AS (SELECT DISTINCT c.doc_id, c.item FROM c JOIN v ON c.item = v.item AND c.phrase = v.phrase JOIN p ON p.doc_id = c.doc_id AND p.word = v.word AND p.place BETWEEN c.s0 + v.o - 2 AND c.s0 + v.o + 2
              GROUP BY c.doc_id, c.item, c.phrase, c.s0, v.n HAVING count(DISTINCT v.o) = v.n),
        y AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT doc_id, item FROM x EXCEPT SELECT doc_id, item FROM m) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, '') AS near_items
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN y USING (doc_id)
    """,
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, d.payload_digest,
               CASE WHEN kept IS NULL OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND payload_bytes >= 1000
    """,
}
