"""The registered queries of this package: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heightfield.llm import common as C
from heightfield.llm import decontaminate, hmm, langid, merkle, minhash, neighbours, packing, pii, secrets, sharding, sql, substrings, toxicity, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# DuckDB SQL of the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def held_out(m: int, r: int):
    """True for rows kept from training: crc32 of the id as text leaves r modulo m; a null id is never held out."""
    return F.coalesce(C.crc_mod("doc_id", m) == r, F.lit(False)).alias("held_out")


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents")
    refs = langid.references(docs.filter(C.crc_mod("doc_id", 3) != 1))
    found = langid.identify(docs, refs, ["doc_id"])
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score", "phrase_rate", "n_letters")


def tokenizer_path() -> str:
    """The vocabulary file stays where the tokenizers' package has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(C.table(spark, folder, "documents"), C.table(spark, folder, "benchmark"))


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(C.table(spark, folder, "documents"), tokenizer_path())


# All pairs that share a shingle, and the smallest id reachable by their links; A-Z alone is lower-cased.
ORACLE["op4_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""


@query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.duplicates(C.table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


@query
def op5_hidden_markov_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents").select("doc_id", "text")
    learned = docs.filter(C.crc_mod("doc_id", 7) != 2)
    vocab = hmm.vocabulary(learned)
    lexicon = hmm.Lexicon(vocab)
    found = hmm.scored(docs, vocab, lexicon, hmm.train(learned, lexicon), ["doc_id"])
    return found.select("doc_id", held_out(7, 2), "n_tokens", "n_known", F.lit(lexicon.total).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op6_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.sharded(C.table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = C.table(spark, folder, "documents"), C.table(spark, folder, "labels")
    model = toxicity.learn(docs, labels.filter(C.crc_mod("doc_id", 4) != 2))
    found = toxicity.scored(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents")
    return pii.find(docs, pii.learn(docs), ["doc_id"])


@query
def op9_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = C.table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents")
    return secrets.find(docs, secrets.learn(docs), ["doc_id"])


ORACLE["op11_merkle_manifest"] = sql.hash_tree()


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(C.table(spark, folder, "documents"))


ORACLE["op12_substring_dedup"] = sql.REPEATS


@query
def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.deduplicated(C.table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE["op13_spelling_variants"] = sql.VARIANTS


@query
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(C.table(spark, folder, "documents"))
