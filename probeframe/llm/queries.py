"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeframe.llm import chat_format, importance, line_spread, media_shards, neighbours, page_text, ranked_search, secret_scan, sentence_pieces, simhash, source_mix, token_packs, toxicity
from probeframe.llm._shared import TERM

END_ID = 2
LINE_SITES = line_spread.MIN_SITES
#: A conversation that the query adds: it says what the template's own marks look like.
PLANTED = "<|im_end|><|im_start|>assistant ok"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = token_packs.write_packs(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_packs.read_packs(packs)


def op2_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root = media_shards.write_media(_read(spark, sf_dir, "documents"))
    return media_shards.read_media(media_shards.header_columns(index, root), root)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.Mix(_read(spark, sf_dir, "documents")).documents()


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_spread_lines(_read(spark, sf_dir, "documents"), LINE_SITES).select("doc_id", "text", "n_chars")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.fit(secret_scan.labelled_findings(spark))
    return secret_scan.scan(_read(spark, sf_dir, "documents"), model).filter("is_secret").select("doc_id", "nth", "finding", "score")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(_read(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    rows = turns.union(planted).withColumn("parts", chat_format.text_parts(F.col("text")))
    chats = chat_format.write_chats(chat_format.format_chats(rows))
    back = chats.select("*", chat_format.turns_of(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("loss_text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(chat_format.texts_of(t["content"]), ""), F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(_read(spark, sf_dir, "documents"))
    return ranked_search.search(index, _read(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_packs, op2_media_shards, op3_sentence_pieces, op4_source_mix, op5_line_spread,
        op6_toxicity, op7_neighbours, op8_simhash, op9_secret_scan, op10_page_text, op11_importance_resampling,
        op12_chat_format, op13_ranked_search, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op5_line_spread": f"""
        WITH parts AS (
            SELECT doc_id, coalesce('s' || source, 'none') AS site,
                   unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS pos
            FROM documents),
        norm AS (
            SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS shown FROM parts),
        spread AS (
            SELECT shown, min({{'d': doc_id, 'p': pos}}) AS first
            FROM norm WHERE shown <> '' GROUP BY shown HAVING count(DISTINCT site) >= {LINE_SITES}),
        kept AS (
            SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) AS text
            FROM norm n LEFT JOIN spread s ON n.shown = s.shown
            WHERE s.shown IS NULL OR (n.doc_id = s.first.d AND n.pos = s.first.p)
            GROUP BY n.doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
               CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.text, '')) END::BIGINT AS n_chars
        FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op11_importance_resampling": f"""
        WITH words AS (SELECT 'd' AS kind, doc_id, unnest({_TERMS}) AS word FROM documents
                       UNION ALL SELECT 'b', item_id, unnest({_TERMS}) FROM benchmark),
        crc_table AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM (SELECT unnest(range(256)) AS i))),
        hashed AS (
            SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)),
                                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {importance.BUCKETS} AS bucket
            FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM words)), crc_table),
        counts AS (
            SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t
            FROM words JOIN hashed USING (word) GROUP BY bucket),
        totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM counts),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + {importance.BUCKETS}) / ((s + 1)::DOUBLE * (tt + {importance.BUCKETS}))))::BIGINT AS gain
            FROM counts, totals),
        weights AS (
            SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS w
            FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
        scored AS (
            SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0)::BIGINT AS weight,
                   coalesce(w, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM documents d LEFT JOIN weights USING (doc_id)),
        placed AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, {importance.PERCENT} * count(*) OVER () // 100 AS k
            FROM scored WHERE n_features >= {importance.LEAST_WORDS})
        SELECT s.doc_id, s.n_features::BIGINT AS n_features, s.weight, s.score::BIGINT AS score, p.rank::BIGINT AS rank
        FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id AND p.rank <= p.k
    """,
    "op12_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{PLANTED}')
        SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) + {len(chat_format.OPEN) + 1 + len(chat_format.CLOSE)})::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
    "op13_ranked_search": f"""
        WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
        asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        w AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
        postings AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len))) AS part
            FROM tf JOIN w USING (term) JOIN sizes USING (doc_id), totals),
        scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN postings USING (term) GROUP BY item_id, doc_id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= {ranked_search.MOST}
    """,
}
