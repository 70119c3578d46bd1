"""The operators of this subpackage applied to whole tables, one query each."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import scratch

from . import chat, pieces, token_counts, toxicity
from .embedding_dedup import embedding_duplicates
from .html_text import extract_text
from .minhash_dedup import near_duplicates
from .neighbours import nearest_neighbours
from .packing import CAPACITIES, best_fit_packing
from .substring_dedup import substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), CAPACITIES)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


#: Where the public tokenizers are, unless QUERN_TOKENIZERS names another folder.
TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their way back, by the merges that define the file's ids and, from the same pieces as a
    unigram model, by Viterbi; a word mark inside a text comes back as a space, as in the library."""
    vocabulary = pieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = pieces.encode(docs, vocabulary, ids_col="ids", decoded_col="decoded", beside={"unigram": vocabulary.as_unigram()})
    given = F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ")
    made = [c for n in ("", "unigram_") for c in (F.size(f"{n}ids").cast("long").alias(f"{n}n_tokens" if n else "n_tokens"), F.xxhash64(f"{n}ids").alias(f"{n}ids_xxhash64"), (F.col(f"{n}decoded") == given).alias(f"{n}restored"))]
    return back.select("doc_id", *made, (F.col("ids") != F.col("unigram_ids")).alias("differs"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 100 = 0"), k=10)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.toxicity(docs, model, out_col="score")
    predicted = (F.col("score") >= F.lit(toxicity.DEFAULT_THRESHOLD)).cast("int")
    return out.select("doc_id", F.coalesce(toxicity.part("doc_id") == 2, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"), F.col("rejected").alias("over_language_threshold"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents, the same batch once more, documents labelled toxic deleted, and documents
    labelled of low quality counted again with an end mark."""
    ranks = token_counts.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    counted = scratch.save(token_counts.count_tokens(table(spark, sf_dir, "documents"), ranks), "counted")
    versions = F.explode(F.array(F.struct(F.lit("byte_bpe_50k").alias("version"), F.col("tokens").alias("n")), F.struct(F.lit("words").alias("version"), F.col("words").alias("n"))))
    every = counted.select("doc_id", "source", "lang", versions.alias("v")).select("doc_id", "v.version", "source", "lang", F.col("v.n").alias("tokens"))
    labels = table(spark, sf_dir, "labels")
    change = lambda df, op, add=0: df.select("doc_id", "version", "source", "lang", (F.col("tokens") + add).alias("tokens"), F.lit(op).alias("op"), F.lit(0).cast("long").alias("seq"))
    rollup = token_counts.Rollup(spark, f"{scratch.folder(spark)}/quern-rollup-{uuid.uuid4().hex}")
    scratch.keep(rollup.folder, spark)
    for _ in range(2):
        rollup.commit("all documents", change(every, "upsert"))
    rollup.commit("toxic documents", change(every.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id"), "delete"))
    low = labels.where("quality = 0 and toxic <> 1").select("doc_id").distinct()
    rollup.commit("low quality counted again", change(every.where("version = 'byte_bpe_50k'").join(low, "doc_id"), "upsert", 1))
    scratch.drop(counted)
    return rollup.totals().withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})


#: A conversation made of nothing but control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string")
    return chat.chat_format(rows.union(hostile)).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what the formatted conversations hold, by their text and loss mask alone."""
    for b in batches:
        out = []
        for conv, text, loss in zip(b["conv_id"].to_pylist(), b["text"].to_pylist(), b["loss"].to_pylist(), strict=True):
            turns = chat.read_turns(text)
            learned = "".join(chat.unescape(text[x["start"] : x["stop"]]) for x in loss)
            every = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((conv, len(turns), _sha(every), len(learned), _sha(learned), len(text)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (pipeline, op1_best_fit_packing, op2_substring_dedup, op3_sentencepiece, op4_embedding_dedup, op5_minhash_dedup, op6_nearest_neighbours, op7_toxicity, op8_html_text, op9_token_counts, op10_chat_format)}


#: Words as the contracts define them, for DuckDB.
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
REACH = "reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: What the template adds to the texts: marks of a turn, and a backslash for each control string and backslash.
MARKED = r"CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15 ELSE 18 + length(role) END + length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|<\|/?turn\|>?'))"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("text")} AS ws FROM documents),
            starts AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM d),
            rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(ws[i:i + 34], ' ')) AS n FROM starts) t WHERE n > 1),
            w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
            m AS (SELECT w.r, w.i, w.word, max(rep.i IS NOT NULL) OVER (PARTITION BY w.r ORDER BY w.i ROWS 34 PRECEDING) AS gone FROM w LEFT JOIN rep ON w.r = rep.r AND w.i = rep.i)
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN (SELECT r, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS k FROM m GROUP BY r) s USING (r)""",
        "op4_embedding_dedup": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
            links AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.9), {REACH}
            SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, c AS component_id, c = id AS kept FROM nodes JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) t ON a = id""",
        "op5_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, {WORDS.format(LOWER)} AS ws FROM documents),
            s AS (SELECT id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w),
            nodes AS (SELECT id, len(sh) AS n FROM s), e AS (SELECT id, unnest(sh) AS x FROM s),
            links AS (SELECT a, b FROM (SELECT p.id AS a, q.id AS b, count(*) AS k FROM e p JOIN e q ON p.x = q.x AND p.id <> q.id GROUP BY ALL) t JOIN nodes na ON a = na.id JOIN nodes nb ON b = nb.id WHERE 100 * k >= 85 * (na.n + nb.n - k)), {REACH}
            SELECT id AS doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, c = id AS kept FROM nodes JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) t ON a = id""",
        "op10_chat_format": f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(3 + sum({MARKED}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id""",
    }
