"""The registered queries of this package, each next to the SQL it must agree with where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.llm import (
    bitsliced, bpe, chat, language, lattice, minhash, mixing, ordinal, phrases, pseudonyms, sharding, spotsigs, whitening,
)
from sieve.llm.common import documents, prepared, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# crc32 (reflected polynomial 0xEDB88320) over the bytes of a text, for an engine without that function.
CRC_SQL = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
              ORDER BY i) AS crc
  FROM range(256) r(i))"""


def crc_sql(blob: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    step = "lambda c, o: xor(c // 256, crc[xor(c, o) % 256 + 1])"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {octets}), {step}))"


def feistel_sql(x: str, rows: str, key: str) -> str:
    """The network as nested selects over ``rows``, which has ``x``, ``a`` and ``b``."""
    sql = f"SELECT *, {x} // b AS l, {x} % b AS r FROM {rows}"
    for i in range(sharding.ROUNDS):
        here, other, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        f = f"CAST('0x' || substr(md5('{key}:{i}:' || {other}), 1, 12) AS BIGINT)"
        sql = f"SELECT * REPLACE (({here} + {f}) % {side} AS {here}) FROM ({sql})"
    return sql


@query("op2_feistel_shards", f"""WITH RECURSIVE {CRC_SQL},
base AS (
  SELECT doc_id, coalesce(text, '') AS t, text IS NULL AS none FROM documents),
sized AS (
  SELECT doc_id, CAST(CASE WHEN none THEN 1 ELSE strlen(t) + 1 END AS BIGINT) AS size,
         {crc_sql("encode(t)")} AS text_crc32 FROM base, crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n FROM sized),
sides AS (
  SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM sized))),
walk AS (
  SELECT x AS start, l * b + r AS x FROM ({feistel_sql("x", "(SELECT x, a, b FROM numbered, sides)", "0")})
  UNION ALL
  SELECT start, l * b + r AS x FROM ({feistel_sql("x", "(SELECT start, x, a, b FROM walk, sides WHERE x >= n)", "0")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(w.x % 16 AS INTEGER) AS shard, CAST(w.x // 16 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM numbered s JOIN walk w ON s.x = w.start WHERE w.x < s.n""")
def feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 2: all documents in 16 shards. Law: ``rows``."""
    text = text_or_empty()
    slim = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.sharded(slim, ["doc_id", "text_crc32", "size"], 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def tokenizer(spark: SparkSession) -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op8_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 8: token ids of every whole text and the bytes decoded from them, as digests."""
    return bpe.round_trip(documents(spark, sf_dir), tokenizer(spark), keep=["doc_id"])


@query("op9_source_mix", """WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
weighted AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT 1 AS round, CAST(sum(source_size) AS DOUBLE) / sum(weight) AS level FROM weighted
  UNION ALL
  SELECT round + 1, (SELECT (sum(source_size) - 3.0 * sum(CASE WHEN weight * level >= 3 * source_size THEN source_size ELSE 0 END))
                     / sum(CASE WHEN weight * level >= 3 * source_size THEN 0 ELSE weight END) FROM weighted)
  FROM levels WHERE round < 30),
last AS (SELECT max(level) AS level FROM levels),
rates AS (
  SELECT source, source_size, least(3.0 * source_size, weight * level) AS target,
         CASE WHEN source_size > 0 THEN least(least(3.0 * source_size, weight * level) / source_size, 3.0) ELSE 0 END AS rate
  FROM weighted, last)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       CAST(size * (floor(rate) + ceil(j * (rate - floor(rate)) - u) - ceil((j - 1) * (rate - floor(rate)) - u)) AS BIGINT) AS taken
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, t) AS j,
             CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM sized) s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source""")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 9: how many words the mix takes of each document. ``target`` is rounded to 3 decimals."""
    plan = mixing.planned(documents(spark, sf_dir).select("doc_id", "source", "text"), keep=["doc_id"])
    return plan.select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("copies") * F.col("size")).alias("taken")
    )


# An example key; a user passes a secret one.
PSEUDONYM_KEY = b"example key of the test queries"


@query("op3_languages")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3: language of every document from its text, its catalogue entry and the habits of its source."""
    docs = documents(spark, sf_dir)
    model = language.fit_texts(docs, "lang")
    return language.identified(docs, model, declared=F.col("lang"), host=F.col("source"), keep=["doc_id", "lang", "source"])


@query("page_languages")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3 over web pages: visible text, the language the markup declares, address suffix and host."""
    model = language.fit_texts(documents(spark, sf_dir), "lang")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    host = F.when(host != "", host)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]{2,3})", 1))
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return language.identified(
        pages, model, text=visible, declared=F.when(declared != "", declared), suffix=F.substring_index(host, ".", -1), host=host,
        keep=["page_id", "url"],
    )


@query("op5_circulant_minhash", """WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
each AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sets p ON a = p.doc_id JOIN sets q ON b = q.doc_id WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN pairs ON r = a),
least_of AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sets s JOIN least_of l ON s.doc_id = l.doc_id""")
def circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 5: components of documents with a Jaccard similarity of 0.85 or more on five-word shingles."""
    return minhash.clustered(documents(spark, sf_dir), 85).select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_pseudonyms")
def pseudonymised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 10: every document with validated personal data replaced by pseudonyms of the same format."""
    return pseudonyms.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)


@query("op1_subword_lattice")
def subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1: log10 probability of every whole text, learned from six sevenths of the documents."""
    import public_tokenizers

    return lattice.scored(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_spot_signatures")
def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 4: fingerprints of every text and of its edited text, and how near they are to each other."""
    beside = spotsigs.beside_next(documents(spark, sf_dir), whole=True)
    own, edited = F.col("signatures"), F.col("edited_signatures")
    return beside.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.fingerprint(own).alias("fingerprint"),
        spotsigs.fingerprint(edited).alias("edited_fingerprint"),
        spotsigs.likeness(own, edited).alias("near_edited"),
        spotsigs.likeness(own, F.col("next_signatures")).alias("near_next"),
        "next_doc_id",
    )


@query("op7_bit_sliced_top_k", """WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""")
def bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 7: the five best rows by inner product for every row whose id is divisible by 50."""
    rows = prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return bitsliced.top_k(rows, rows.filter("vec_id % 50 = 0"), 5)


@query("op6_ordinal_quality")
def ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6: expected grade of every document; ratings: 0 toxic, 1 of low quality, 2 good."""
    docs = documents(spark, sf_dir)
    grade = F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1)
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", grade.alias("grade"))
    model = ordinal.fit_ratings(docs, ratings)
    found = ordinal.graded(docs.select("doc_id", "text"), model)
    tails = [F.col("at_least")[g].alias(f"at_least_{g}") for g in model.grades[1:]]
    return found.select("doc_id", "expected_grade", *tails, "kept")


@query("op11_whitened_embeddings")
def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 11: every usable vector on the first sixteen components of the distinct vectors' covariance."""
    rows = prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.components(rows.select("vec_id", "embedding"))


CONTROL_TURNS = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]


def _chat_sql() -> str:
    pattern, by = chat.Template().escaping
    escaped = f"regexp_replace({{}}, '{pattern}', '{by}', 'g')"
    marks = sum(len(m) for m in (chat.Template().opens, chat.Template().parts, chat.Template().closes))
    return f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {", ".join(f"(-1, {i}, '{r}', '{t}')" for i, (r, t) in enumerate(CONTROL_TURNS))}) v(conv_id, turn, role, text)),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text)) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '') AS learned,
         CAST(sum(length({escaped.format("role")}) + length({escaped.format("text")}) + {marks}) AS BIGINT) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM whole"""


@query("op12_chat_format", _chat_sql())
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 12: all conversations and one full of control strings, formatted and read back."""
    turns = prepared(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = [(-1, i, role, text) for i, (role, text) in enumerate(CONTROL_TURNS)]
    return chat.digests(chat.formatted(turns.unionByName(spark.createDataFrame(extra, turns.schema))))


@query("op13_phrases", """WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, k AS len, count(*) AS f FROM grams GROUP BY lang, phrase, k),
cand AS (SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.a // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN cand b
  ON b.lang = c.lang AND b.len > c.len AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * b.a >= 80 * c.a),
ranks AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.phrase = w.phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranks JOIN total USING (lang) WHERE rank <= 2000""")
def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 13: the first 2 000 phrases of each language."""
    return phrases.mined(documents(spark, sf_dir))
