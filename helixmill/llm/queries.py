"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import alignment, bpe, ctw, exact_dedup, html_text, language, whitening
from .decontaminate import containments
from .embedding_dedup import EmbeddingDedup
from .near_dedup import NearDedup
from .quality import ImportanceResampling
from .sharding import shard
from .stage import read
from .toxicity import OrdinalToxicity
from .vocabulary import pair, vocabulary

def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of each whole document and back, as digests."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), *vocabulary())


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles agree by 85 of 100 or more."""
    return NearDedup(k=3, percent=85)(read(spark, sf_dir, "documents")).drop("text_hash")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained by four fifths of their shingles in a document."""
    return containments(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of each document by ordinal regression on the labelled ones."""
    docs = read(spark, sf_dir, "documents")
    return OrdinalToxicity().fit(docs, read(spark, sf_dir, "labels")).transform(docs)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard(read(spark, sf_dir, "documents"), 40)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by the ratio of target and raw text models."""
    docs = read(spark, sf_dir, "documents")
    return ImportanceResampling().fit(docs, read(spark, sf_dir, "labels")).transform(docs)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by the phrases that it needs, learnt from four fifths of the labelled ones."""
    return language.evaluate(read(spark, sf_dir, "documents"))


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document by context-tree weighting, learnt from nine tenths."""
    return ctw.score(read(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of vectors that links at cosine 0.9 or more connect."""
    return EmbeddingDedup()(read(spark, sf_dir, "embeddings"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two public tokenizers over each whole document, aligned where both end."""
    return alignment.align(read(spark, sf_dir, "documents"), pair())


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents, found by adding them to a digest index in four batches, larger ids first."""
    return exact_dedup.groups(read(spark, sf_dir, "documents"), batches=4)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector, by merged singular value decompositions."""
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_near_dedup": op2_near_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_ctw": op8_ctw,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_html_text": op10_html_text,
    "op11_alignment": op11_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}


def _words(text: str) -> str:
    """DuckDB: the words of a text, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str, k: int) -> str:
    """DuckDB: (key, sh) for each distinct shingle."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {k}
        THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM (SELECT {key}, {_words('text')} AS w FROM {table})"""


ORACLES: dict[str, str] = {
    "op2_near_dedup": f"""
WITH RECURSIVE s AS MATERIALIZED ({_shingles("documents", "doc_id", 3)}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS v FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.v),
c AS (SELECT doc_id, min(v) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op3_decontaminate": f"""
WITH q AS MATERIALIZED ({_shingles("benchmark", "item_id", 5)}),
d AS ({_shingles("documents", "doc_id", 5)}),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT doc_id, item_id, count(*) / any_value(n) AS containment FROM q JOIN d USING (sh) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)""",
    "op12_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
