"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language_id, licenses, mixing, near_duplicates, nearest, packing, periodic_runs, quality_knn, quality_rules, spelling, token_counts
from .common import WORD, table
from .sql import PERIODIC_RUNS, SPELLING_VARIANTS


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    dictionaries = language_id.learn_dictionaries(docs.where(~held))
    found = language_id.identify_languages(docs, dictionaries)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.license_table(spark))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def quality_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = quality_held_out()
    model = quality_knn.fit(docs.where(~held), labels.where(~held))
    return quality_knn.score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), bpe_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", words), (-1, 1, "assistant", words)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(given.unionByName(own), bpe_path()))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), bpe_path())


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), bpe_path())
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def mistyped(docs: DataFrame) -> DataFrame:
    """The words of the texts: maximal runs of Latin letters, of which only A-Z are lower-cased, without one letter where the crc32 of
    `<doc_id>:<run>` (no id: empty) is divisible by 31. Runs below seven letters can't give words of seven."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z\u00C0-\u00FF]{7,})"))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(mistyped(table(spark, sf_dir, "documents")))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the crc32 h of the decimal doc_id ends in 0 for a tenth of the documents: in those the words from
    a = g % n on repeat the first 1 + (n - a) // (3 + g % 8) of them, g = h // 10. Other texts, and those without an id or words, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})")))
    cut = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words").cast("long"))
    cut = cut.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    loop = F.expr("slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) DIV p + 1))), 1, int(n - a))")
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(words, 1, int(a))"), loop), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looped(table(spark, sf_dir, "documents")))
    best = F.expr("array_sort(runs, (x, y) -> CASE WHEN x.length * y.period <> y.length * x.period THEN IF(x.length * y.period > y.length * x.period, -1, 1) WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) ELSE int(sign(x.period - y.period)) END)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.try_element_at(best, F.lit(1)).alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_mixing, op3_licenses, op4_near_duplicates, op5_quality, op6_packing, op7_chat_format, op8_token_counts, op9_nearest, op10_quality_rules, op11_bpe, op12_spelling_variants, op13_periodic_runs)
}


def _mixing_sql() -> str:
    return """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT key, source_size, CAST(2.0 AS DOUBLE) * source_size AS cap, [3, 1, 2][((row_number() OVER (ORDER BY key) - 1) % 3) + 1] AS weight FROM s),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT key, source_size, least(cap, (max(lev) OVER ()) * weight) AS target, CAST('0x' || substr(md5('mix:' || key), 1, 7) AS BIGINT) / CAST(268435456.0 AS DOUBLE) AS u FROM l),
r AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY key ORDER BY CASE WHEN size < 4096 THEN size // 32 ELSE 128 + least(size // 4096, 1000) END, hash, size) AS k
      FROM d JOIN t USING (key))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(floor(k * rate + u) - floor((k - 1) * rate + u), 2) AS BIGINT) AS taken FROM r"""


def _licenses_sql() -> str:
    def form(column: str) -> str:
        out = f"chr(10) || translate(lower({column}), chr(1) || chr(2), '  ')"
        out = f"regexp_replace({out}, '{licenses.BEGINNING}', '\\1' || chr(2) || '\\2', 'g')"
        out = f"regexp_replace({out}, '{licenses.CLAUSE}', 'copyright' || chr(1) || '\\1', 'g')"
        out = f"regexp_replace(regexp_replace({out}, '(?m){licenses.LINE}', chr(10), 'g'), '{licenses.WITHIN}', chr(10), 'g')"
        out = f"regexp_replace({out}, '{licenses.RESERVED}', ' ', 'g')"
        out = f"""' ' || regexp_replace({out}, '{licenses.NOT_WORDS}', '  ', 'g') || ' '"""
        for spelling, same in licenses.SPELLINGS.items():
            out = f"replace({out}, ' {spelling.replace(' ', '  ')} ', ' {same.replace(' ', '  ')} ')"
        return f"trim(replace({out}, '  ', ' '))"

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.forms())
    return f"""
WITH k AS (SELECT sha256({form("v.t")}) AS digest, min(v.i) AS license_id FROM (VALUES {values}) v(i, t) GROUP BY 1),
d AS (SELECT doc_id, {form("text")} AS c FROM documents),
e AS (SELECT doc_id, CASE WHEN length(c) > 0 THEN sha256(c) END AS digest, CAST(coalesce(length(c), 0) AS BIGINT) AS n_chars FROM d)
SELECT doc_id, digest, n_chars, license_id FROM e LEFT JOIN k USING (digest)"""


SQL = {"op2_mixing": _mixing_sql(), "op3_licenses": _licenses_sql(), "op12_spelling_variants": SPELLING_VARIANTS, "op13_periodic_runs": PERIODIC_RUNS}
