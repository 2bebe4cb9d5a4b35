"""The corpus operators as registered queries, with reference SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsmith.llm import bpe, chat, divergence, html_extract, infill, mixing, ngram_join, pii, quality_rules, ranking, sharding, simhash, trie_dedup

QUERIES = {}
ORACLES = {}

SHARDS = 24
MIX = mixing.Mix(entropy=0.95, repeats=4.0, budget=1.0)
RATIO = quality_rules.Ratio()


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the search, for ids divisible by 100: ``n_within``, the documents within the radius, itself included, and
    ``within``, their classes of equal fingerprints by smallest id; rows with such a fingerprint are the members."""
    made = simhash.fingerprint_documents(read(spark, sf_dir, "documents"))
    made = simhash.checkpointed(made)
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    found = simhash.find_within(made.select("fingerprint", "doc_id"), made.filter(asked))
    classes = F.sort_array(F.collect_list(F.struct("doc_id", F.col("found").alias("fingerprint"))))
    near = found.groupBy("fingerprint").agg(F.sum("n").alias("n_within"), classes.alias("within"))
    answered = made.filter(asked).join(near, "fingerprint", "left")
    return made.filter(~asked).unionByName(answered, allowMissingColumns=True)


def _mix_sql(mix: mixing.Mix) -> str:
    """The same draw in SQL: a recursive bisection of the exponent, then running sums over permuted blocks."""
    number = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens,
         {number.format("coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')")} AS h
  FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS docs, sum(tokens) / (SELECT sum(tokens) FROM d)::DOUBLE AS share FROM d GROUP BY source HAVING sum(tokens) > 0),
ent(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid,
        (SELECT ln(sum(pow(share, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(share, (lo + hi) / 2) * ln(share)) / sum(pow(share, (lo + hi) / 2))
                >= {mix.entropy} * ln(count(*)) - 1e-12 FROM s) AS ok FROM ent WHERE k < 45)),
rep(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN bad THEN mid ELSE lo END, CASE WHEN bad THEN hi ELSE mid END
  FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid,
        (SELECT {mix.budget} * max(pow(share, (lo + hi) / 2 - 1)) / sum(pow(share, (lo + hi) / 2)) > {mix.repeats} FROM s) AS bad FROM rep WHERE k < 45)),
ends AS (SELECT ln(count(*)) - 0 >= {mix.entropy} * ln(count(*)) - 1e-12 AS ent0,
                -sum(share * ln(share)) >= {mix.entropy} * ln(count(*)) - 1e-12 AS ent1,
                {mix.budget} * max(1 / share) / count(*) > {mix.repeats} AS rep0,
                {mix.budget} > {mix.repeats} AS rep1 FROM s),
a AS (SELECT round(greatest(
        CASE WHEN ent1 THEN 1.0 WHEN NOT ent0 THEN 0.0 ELSE (SELECT lo FROM ent WHERE k = 45) END,
        CASE WHEN rep1 THEN 1.0 WHEN NOT rep0 THEN 0.0 ELSE (SELECT lo FROM rep WHERE k = 45) END), 6) AS a FROM ends),
b AS (SELECT source, tokens, ceil(docs / {mixing.BLOCK_DOCS}.0)::BIGINT AS blocks,
             floor((SELECT sum(tokens) FROM d) * {mix.budget} * pow(share, (SELECT a FROM a)) / (SELECT sum(pow(share, (SELECT a FROM a))) FROM s) + 0.5)::BIGINT AS budget FROM s),
p AS (SELECT d.*, b.tokens AS whole, b.budget, d.h % b.blocks AS block FROM d JOIN b USING (source)),
w AS (SELECT *, sum(tokens) OVER q - tokens AS before_doc, row_number() OVER q - 1 AS slot FROM p
      WINDOW q AS (PARTITION BY source, block ORDER BY h, doc_id, tokens ROWS UNBOUNDED PRECEDING)),
z AS (SELECT source, block, whole, budget, sum(tokens)::BIGINT AS size FROM p GROUP BY ALL),
t AS (SELECT z.*, e.pass, {number.format("source || '|' || CAST(e.pass AS VARCHAR) || '|' || CAST(block AS VARCHAR)")} AS turn
      FROM z, LATERAL (SELECT unnest(range(0, (budget // whole) + 1)) AS pass) e),
o AS (SELECT *, sum(size) OVER r - size AS before_block, row_number() OVER r - 1 AS place, budget - pass * whole AS remaining FROM t
      WINDOW r AS (PARTITION BY source, pass ORDER BY turn, block ROWS UNBOUNDED PRECEDING))
SELECT w.doc_id, w.source, w.tokens::BIGINT AS n_tokens, o.pass::INTEGER AS "pass", o.place::BIGINT AS block, w.slot::BIGINT AS slot
FROM w JOIN o ON w.source = o.source AND w.block = o.block AND o.before_block + w.before_doc < o.remaining"""


@query("op2_mixing", _mix_sql(MIX))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"), MIX)


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


#: Fixed by the query contract: a conversation whose texts hold what a template could mistake for its own marks.
TRAP = "\\### Assistant: </turn> ok"

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"


@query(
    "op4_chat",
    f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.OPEN) + 2 + len(chat.CLOSE)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is rebuilt from a log in which each of its turns was drafted, answered, and written anew."""
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    trap = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRAP).alias("text"),
    )
    events = chat.drafted_log(turns.unionByName(trap))
    return chat.digest_chats(chat.render(chat.fold_events(events)))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.judge(docs, quality_rules.fit_ratio(docs, trusted, RATIO), RATIO)


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.round_trip(read(spark, sf_dir, "documents"), file)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_ranking")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return ranking.score_documents(docs, ranking.fit_quality(docs, read(spark, sf_dir, "labels")))


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_ngram_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op10_html_extract")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


@query(
    "op11_trie_dedup",
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = trie_dedup.mark_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.withColumnRenamed("text_digest", "text_sha256")


def _share_sql(n: str, total: str, terms: str, audit: divergence.Audit) -> str:
    return f"1 + {audit.scale}::HUGEINT * ({n} + {audit.prior}) // ({total} + {audit.prior} * {terms})"


def _audit_sql(audit: divergence.Audit) -> str:
    """Every term of every group, present or not."""
    apart = "((p - q) * (p - q) // (p + q))"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{divergence.UPPER}', '{divergence.LOWER}') AS term
  FROM documents),
v AS (SELECT lang, term, count(*)::HUGEINT AS n FROM d GROUP BY ALL HAVING count(DISTINCT r) >= {audit.min_df}),
l AS (SELECT lang, sum(n) AS total, count(*)::HUGEINT AS terms FROM v GROUP BY lang),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM d GROUP BY ALL),
k AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS lang_n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT lang, source, sum(n) AS total FROM k GROUP BY ALL),
p AS (SELECT k.*, {_share_sql("k.n", "s.total", "l.terms", audit)} AS p, {_share_sql("k.lang_n", "l.total", "l.terms", audit)} AS q
      FROM k JOIN s USING (lang, source) JOIN l USING (lang)),
e AS (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
m AS (SELECT lang, source, item, sum({apart}) AS value FROM e GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, {apart} FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
WHERE part = 'pair' OR rank <= {audit.top}"""


AUDIT = divergence.Audit()


@query("op12_divergence", _audit_sql(AUDIT))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"), AUDIT)


_HEX = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
_JOINED = "coalesce(array_to_string({}, ''), '')"


@query(
    "op13_infill",
    f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
c AS (
  SELECT *, len(units) AS n, {_HEX.format(1)} % (len(units) + 1) AS x, {_HEX.format(9)} % (len(units) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_HEX.format(17)} % 100 >= 90 THEN 'plain'
              WHEN {_HEX.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, {_JOINED.format("units[1:least(x, y)]")} AS pre, {_JOINED.format("units[least(x, y) + 1:greatest(x, y)]")} AS mid,
         {_JOINED.format("units[greatest(x, y) + 1:n]")} AS suf
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
